"""Quality classifier by importance resampling.

Two bags of hashed word n-grams (one and two words, ``FEATURES`` buckets) are
estimated: the target's from labelled good texts, the raw one from all texts
of the corpus. A text's log weight is the sum over its n-grams of log(target
share / raw share): how much likelier it is under the target. Such a sum grows
with the text, and so do its noise and the loss of a text that the target has
not seen; so each length has its own cut. Texts fall into bands by the power of
two of their number of n-grams, and a band's cut is the mean log ratio that
``KEEP_GOOD`` of the good labelled rows in it reach (a band with fewer than
``BAND_ROWS`` of them takes the cut of the nearest that has enough). A text's
margin is its log weight less its n-grams times its band's cut.

Documents are resampled without replacement by Gumbel top-k: a Gumbel number
drawn from the id is added to each margin, and the k largest stay. k is the
number of rows with a margin of at least 0: the corpus' own share of texts
like the target. Half of the good labelled rows make the target, the other
half, unseen by it, sets the cuts.

The raw counts cover every text. The target's labels are a bounded sample: the
``max_labels`` labelled rows with the smallest hashes of their ids.

Exact top k without a sort of all rows: the k-th largest key is found by
counting keys in 2**16 buckets of their order-preserving 64-bit form, four
rounds of 16 bits; rows with exactly that key all stay.

Defined results: a text without words (null, empty, blank) has log weight 0, the
lowest margin and key, and never stays. Rows
that repeat id and text share one key and one fate. Labels that are null
count as missing; a document with several labels is good if any says so.
Without any good label all weights are 0 and all rows with words stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, map_batches, pieces, sized, staged, text_bytes, uniform

FEATURES, MAX_LABELS, SMOOTH, KEEP_GOOD, BAND_ROWS, BANDS = 1 << 16, 20_000, 5.0, 0.995, 50, 64
_PAIR = np.uint32(0x9E3779B1)
SCORES = ("log_weight", "margin", "band", "each", "key", "bits")


def features(text: bytes) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    words = np.fromiter(map(zlib.crc32, text.lower().split()), dtype=np.uint32)
    mixed = words[1:] ^ (words[:-1] * _PAIR + np.uint32(0x85EBCA6B))
    both = np.concatenate([words, mixed * _PAIR])
    return ((both ^ (both >> np.uint32(15))) % np.uint32(FEATURES)).astype(np.int64)


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
        max_labels: int = MAX_LABELS) -> tuple[np.ndarray, DataFrame]:
    """The weight of each bucket, and the ids of the good labelled rows left out (a staged table)."""
    own = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("__label_id")) \
        .agg((F.max(col(label_col)) > 0).alias("__good"))
    used = staged(own.orderBy(F.xxhash64("__label_id"), "__label_id").limit(max_labels).where("__good"), "labels")
    left_out = F.pmod(F.xxhash64(F.lit("left out"), "__label_id"), F.lit(2)) == 0
    rows = df.select(col(id_col).alias("__id"), text_bytes(text_col).alias("text")) \
        .join(F.broadcast(used.where(~left_out)), F.col("__id") == F.col("__label_id"), "left") \
        .select("text", F.col("__good").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            good = batch.column("good").to_pylist()
            for start, texts in pieces(batch, "text"):
                found = [features(t) for t in texts]
                counts[0] += np.bincount(np.concatenate(found), minlength=FEATURES)
                if target := [f for i, f in enumerate(found, start) if good[i]]:
                    counts[1] += np.bincount(np.concatenate(target), minlength=FEATURES)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])],
                                         ["bucket", "n_raw", "n_good"])

    found = (map_batches(rows, run, "bucket bigint, n_raw bigint, n_good bigint")
             .groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good")).toArrow())
    counts = np.zeros((2, FEATURES))
    at = found.column("bucket").to_numpy()
    counts[0][at], counts[1][at] = found.column("n_raw").to_numpy(), found.column("n_good").to_numpy()
    if not counts[1].any():
        return np.zeros(FEATURES), used.where(left_out)
    # raw counts on the target's scale, and the same pseudo-counts for both: rare buckets say little
    expected = counts[0] * (counts[1].sum() / counts[0].sum())
    return np.log((counts[1] + SMOOTH) / (expected + SMOOTH)), used.where(left_out)


class Scorer(NamedTuple):
    weights: np.ndarray  # of each bucket of n-grams
    cuts: np.ndarray     # of each band of lengths, by n-gram


def with_keys(df: DataFrame, scorer: Scorer, text_col: str = "text", id_col: str = "doc_id",
              seed: str = "importance") -> DataFrame:
    """``df`` with __log_weight, __margin, __band, __each (log weight by n-gram), __key (the margin plus a Gumbel number)
    and __bits, the key as an unsigned 64-bit number, in a long, in the order of the doubles. One function, so one
    Python worker a task."""

    @F.pandas_udf("log_weight double, margin double, band int, each double, key double, bits long")
    def scored(texts: pd.Series, u: pd.Series) -> pd.DataFrame:
        found = np.array([(len(f), scorer.weights[f].sum()) for f in (features(bytes(t)) for t in texts)],
                         dtype=np.float64).reshape(-1, 2)
        n, log_weight = found[:, 0], found[:, 1]
        band = np.frexp(n)[1]
        margin = np.full(len(n), -np.inf)  # a text without n-grams has the lowest place
        margin[n > 0] = (log_weight - n * scorer.cuts[band])[n > 0]
        key = margin - np.log(-np.log(u.to_numpy(dtype=np.float64)))
        raw, top = key.view(np.uint64), np.uint64(1 << 63)
        return pd.DataFrame({"log_weight": log_weight, "margin": margin, "band": band, "each": log_weight / np.maximum(n, 1),
                             "key": key, "bits": np.where(raw & top, ~raw, raw | top).view(np.int64)})

    return df.withColumn("__scored", scored(text_bytes(text_col), uniform(id_col, seed))).select(
        *[col(c) for c in df.columns], *[F.col(f"__scored.{c}").alias(f"__{c}") for c in SCORES])


def band_cuts(df: DataFrame, weights: np.ndarray, used: DataFrame, text_col: str, id_col: str, keep_good: float) -> np.ndarray:
    """The cut of each band, from the rows of ``df`` with an id in ``used``."""
    good = df.select(col(id_col), col(text_col)).join(F.broadcast(used), col(id_col) == F.col("__label_id"), "left_semi")
    scored = with_keys(good, Scorer(weights, np.zeros(BANDS)), text_col, id_col).where("__band > 0")
    # one group more, of all bands, for when none has enough rows
    found = {r[0]: (r[1], r[2]) for r in scored.select(F.explode(F.array("__band", F.lit(-1))).alias("band"), "__each")
             .groupBy("band").agg(F.count("*"), F.percentile("__each", 1.0 - keep_good)).collect()}
    enough = sorted(b for b, (n, _) in found.items() if b >= 0 and n >= BAND_ROWS) or ([-1] if found else [])
    if not enough:
        return np.full(BANDS, -np.inf)
    return np.array([found[min(enough, key=lambda e: abs(e - b))][1] for b in range(BANDS)])


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the doubles in column ``key``, exactly, in four rounds of counting."""
    if k <= 0:
        return float("inf")
    # hex of a double is its bits; negative ones are turned round so that order is kept
    bits = F.col("bits")
    prefix, left = 0, k
    for r in range(4):
        shift = 48 - 16 * r
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF))
        rows = keys if r == 0 else keys.where(F.shiftrightunsigned(bits, shift + 16) == F.lit(prefix))
        counts = sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if n >= left:
                prefix = prefix << 16 | d
                break
            left -= n
        else:
            return float("-inf")  # k is at least the number of rows
    raw = prefix ^ 0xFFFFFFFFFFFFFFFF if not prefix >> 63 else prefix ^ (1 << 63)
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


def resample(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             label_col: str = "quality", keep_good: float = KEEP_GOOD) -> tuple[DataFrame, Scorer, float]:
    """id, log_weight, margin, key of every row (a staged table), the scorer, and the key from which on rows stay."""
    weights, used = fit(df, labels, text_col, id_col, label_col)
    cuts = band_cuts(df, weights, used, text_col, id_col, keep_good)
    known = bool(np.isfinite(cuts).all())
    scorer = Scorer(weights, cuts if known else np.zeros(BANDS))
    keys = staged(with_keys(df.select(col(id_col), col(text_col)), scorer, text_col, id_col)
                  .select(col(id_col).alias(id_col), *[F.col(f"__{c}").alias(c) for c in SCORES]), "importance")
    k = keys.where("margin >= 0" if known else "band > 0").count()
    return keys, scorer, kth_largest(keys, k)
