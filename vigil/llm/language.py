"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded
sample of its labelled texts. Texts are taken in lower case with a space for
whatever is no letter, so that case and symbols say nothing. A text is cut into chunks of at most
``CHUNK`` bytes, so that the dictionary counts in all of a long text, and
every chunk is compressed with every dictionary. The language with the fewest
bytes in total wins; the margin to the second best gives the score, and a
prediction whose margin is narrow is marked as not accepted.

The sample: for each language the ``sample_rows`` distinct texts with the
smallest hashes, of each at most ``dict_bytes // 8`` bytes, ``dict_bytes`` in
all. It is the only part that does not read all rows.

Defined results: null or letterless text is ``und`` with score 0. Equal sizes
go to the language with more labelled rows, with score 0, not accepted.
Rows with a null label teach nothing. Without any labelled row all texts are
``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces, sized, staged, text_bytes

CHUNK = 2048
LEVEL = 12
#: Relative margin below which a prediction is not accepted, and from which the score is 1.
NARROW, WIDE = 0.005, 0.08
OTHER = re.compile(r"[\W\d_]+")


def plain(text: bytes) -> bytes:
    return OTHER.sub(" ", text.decode("utf-8", "replace").lower()).encode()


def learn_dictionaries(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                       sample_rows: int = 200, dict_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Dictionary content by language, from the labelled rows of ``df``; frequent languages first."""
    each = max(1, dict_bytes // 8)
    labelled = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    text = text_bytes(text_col)
    # ranked without the texts: each distinct text once, then the first by hash
    distinct = (labelled.where(F.octet_length(text) > 0)
                .groupBy(col(lang_col).alias("lang"), F.xxhash64(text).alias("h"))
                .agg(F.min(col(id_col)).alias("id")))
    # a language may have most rows: first ranked in 64 parts, so that few rows meet in one task
    first = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "id"))
    distinct = distinct.withColumn("rank", first).where(F.col("rank") <= sample_rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = staged(distinct.withColumn("rank", rank).where(F.col("rank") <= sample_rows)
                    .select("id", "lang", "h", "rank"), "language-sample")
    rows = (labelled.select(col(id_col).alias("id"), F.substring(text, 1, each).alias("text"),
                            F.xxhash64(text).alias("h"), col(lang_col).alias("lang"))
            .join(sized(chosen), ["id", "lang", "h"]).select("lang", "rank", "text").distinct().collect())
    found: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1], bytes(r[2]))):
        found.setdefault(lang, []).append(plain(bytes(text)))
    often = {r[0]: r[1] for r in labelled.groupBy(col(lang_col)).count().collect()}
    order = sorted(found, key=lambda lang: (-often[lang], lang))
    return {lang: b" ".join(found[lang])[:dict_bytes] for lang in order}


def classifier(dictionaries: dict[str, bytes]):
    """A function from a text to (language, score, accepted)."""
    langs = list(dictionaries)
    coders = []
    for lang in langs:
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False))

    def classify(text: bytes) -> tuple[str, float, bool]:
        text = plain(text)
        chunks = [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in coders]
        if len(sizes) == 1:
            return langs[0], 1.0, True
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return langs[best], min(1.0, margin / WIDE), margin >= NARROW

    return classify


def predict_language(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
                     id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score, accepted for every row of ``df``."""
    if not dictionaries:
        return df.select(col(id_col).alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.lit(False).alias("accepted"))
    rows = df.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"),
                     F.coalesce(col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(dictionaries)
        for batch in batches:
            letters, out = batch.column("letters").to_pylist(), []
            for start, texts in pieces(batch, "text"):
                for i, text in enumerate(texts, start):
                    out.append(classify(text) if letters[i] else ("und", 0.0, False))
            lang, score, accepted = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(accepted, pa.bool_())], ["id", "lang_pred", "score", "accepted"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, lang_pred string, score double, accepted boolean") \
        .withColumnRenamed("id", id_col)
