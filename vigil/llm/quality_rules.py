"""Quality rules: simple counts, and compression bands.

Counts of words, symbols, repeated lines and repeated five-word windows give
the base rules. The method compresses the whole text and each chunk of
``CHUNK`` bytes with zstandard: a text whose whole ratio (bytes by compressed
bytes) is above its length's limit repeats itself, one below the lower limit
is not language; the same holds if more than ``BAD_SHARE`` of its bytes are in
chunks outside of the limits of the chunk's own length, the last, shorter
chunk included. Limits grow with length, since a longer text holds more of
what came before. Lower limits lie between what random words of letters and
digits reach (1.24 at 500 bytes, 1.35 at 4,000; with hexadecimal digits 1.92
from 4,096 on) and prose (at least 1.39 from 256 bytes, 1.72 from 1,024, 2.08
from 4,096). Below 256 bytes they meet, so there is no lower limit.

Defined results: a null or empty text has all counts 0 and fails. A text of a
single chunk is judged as a whole only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces

CHUNK, LEVEL, BAD_SHARE = 4096, 3, 0.5
#: Bytes from which on, least and most ratio of a whole text.
BANDS = ((0, 0.0, 3.0), (256, 1.33, 4.0), (512, 1.4, 4.0), (1024, 1.58, 6.0), (2048, 1.75, 6.0), (4096, 1.95, 8.0),
         (16384, 2.05, 12.0), (65536, 2.05, 20.0))
WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur at least twice."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def ratio(size: int, packed: int) -> float:
    return size / max(1, packed - 9)  # without the frame's header and block header


def within(size: int, found: float) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(BANDS) if size >= least)
    return low <= found <= high


def verdict(text: bytes, coder: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """Kept, the whole text's ratio, and the share of bytes in chunks out of bounds."""
    whole = ratio(len(text), len(coder.compress(text)))
    chunks = [text[a:a + CHUNK] for a in range(0, len(text), CHUNK)] if len(text) > CHUNK else []
    bad = sum(len(x) for x in chunks if not within(len(x), ratio(len(x), len(coder.compress(x)))))
    share = bad / len(text) if chunks else 0.0
    return within(len(text), whole) and share <= BAD_SHARE, whole, share


FIELDS = [("n_words", "bigint", pa.int64()), ("word_chars", "bigint", pa.int64()), ("n_symbols", "bigint", pa.int64()),
          ("n_dup_lines", "bigint", pa.int64()), ("n_repeat_words", "bigint", pa.int64()),
          ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()), ("ratio", "double", pa.float64()),
          ("bad_chunks", "double", pa.float64())]


def judge(text: str, coder: zstandard.ZstdCompressor) -> tuple:
    data = text.encode()
    words = data.split()
    chars = sum(map(len, words))
    if len(data) != len(text):  # beyond ASCII: code points, not bytes
        chars -= len(data) - len(text)
    repeats = repeated_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    kept, whole, share = verdict(data, coder) if data else (False, 0.0, 0.0)
    return (len(words), chars, len(SYMBOLS.findall(text)), repeated_lines(data), repeats, failed,
            kept and not failed, whole, share)


def quality_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, the counts, base_failed, kept, ratio and bad_chunks for every row of ``df``."""
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for batch in batches:
            out = [judge(text or "", coder) for _, texts in pieces(batch, "text") for text in texts]
            cols = list(zip(*out, strict=True)) if out else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")] + [pa.array(c, t) for c, (_, _, t) in zip(cols, FIELDS, strict=True)],
                ["id"] + [f[0] for f in FIELDS])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in FIELDS)) \
        .withColumnRenamed("id", id_col)
