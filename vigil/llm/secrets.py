"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Three patterns find assigned values, access keys and long hexadecimal runs.
Beyond them, every run of at least ``MIN_CHARS`` characters of the base64 and
URL alphabets that holds letters is encoded with a byte-level BPE
vocabulary: ordinary words give three to five characters a token, random
strings hardly two. A run with fewer than ``MAX_RATIO`` characters a token is
reported as ``random``, unless it is a known digest (hexadecimal, of a usual
digest's length), a UUID, or an identifier, or meets a span found by a pattern.
The parts of a run between ``/``, ``=``, ``_``, ``-`` and ``+`` of at least
``MIN_CHARS`` are tested as well, so that words beside a random string don't
hide it; the whole run is reported. A run, or part, is an identifier if it is
made of words: cut at these signs, at digits and where the case rises, the
pieces of letters with ``WORD_RATIO`` characters a token or more hold more
than half of its characters.

Defined results: null or empty text has no spans. Offsets are code points, end
exclusive. Spans come by start, then kind in the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_CHARS, MAX_RATIO, WORD_RATIO = 20, 2.2, 2.5
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9]{20,}")
WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def is_random(word: str, enc: tiktoken.Encoding) -> bool:
    if not any(c.isalpha() for c in word) or DIGEST.fullmatch(word) or UUID.fullmatch(word):
        return False
    if len(word) / len(enc.encode_ordinary(word)) >= MAX_RATIO:
        return False
    words = [w for w in WORD.findall(word) if len(w) >= 4 and len(w) / len(enc.encode_ordinary(w)) >= WORD_RATIO]
    return 2 * sum(map(len, words)) <= len(word)


def random_spans(text: str, enc: tiktoken.Encoding, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for x, y, _ in taken):
            continue
        word = m.group().strip("-_=/+") or m.group()
        if DIGEST.fullmatch(word) or UUID.fullmatch(word):
            continue
        parts = dict.fromkeys([word, *PART.findall(word)])
        if any(len(x) >= MIN_CHARS and is_random(x, enc) for x in parts):
            out.append((a, b, "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """id and ``found``: an array of (start, end, kind) for every row of ``df``."""
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            found = []
            for _, texts in pieces(batch, "text"):
                for text in texts:
                    own = base_spans(text) if text else []
                    if text:
                        own = sorted(own + random_spans(text, enc, own), key=lambda s: (s[0], KINDS.index(s[2])))
                    found.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(span))], ["id", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, found array<struct<start:bigint,end:bigint,kind:string>>") \
        .withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[2] != "random"]).encode()).hexdigest()
