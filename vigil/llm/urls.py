"""URL filter: a sorted array of digests, confirmed by the stored strings.

Entries are hosts with a path prefix and a verdict. Each has a 64-bit xxhash
of ``host + path`` as its key, and entries are dealt to shards by key. Within
a task a shard is a sorted array of keys in a memory-mapped file, beside the
strings; a batch of probes is looked up by one vectorised binary search, and a
hit counts only if the stored string is equal, so that a collision of keys
cannot block a page.

A URL is probed with each of its host's suffixes at label borders and each
path prefix of a length that some entry has. Distinct hosts and paths are
probed once, however many pages have them. Of the entries that fit, those of
the highest tier count, of these the longest wins; of equal ones ``allow`` does.

Defined results: a null URL or one without ``://`` has empty host and path;
an entry with an empty host fits nothing, and entries with nulls are left out.
An empty list of entries, or an empty table, gives no fit.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col

#: Entries that a shard should hold about; the shards' number follows from the count.
SHARD_ENTRIES = 1_000_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), dtype=np.uint64, count=len(strings))


class DigestArray:
    """Sorted keys in a memory-mapped file, and the entries in the keys' order."""

    def __init__(self, strings: list[bytes], verdicts: list[str], path: str) -> None:
        keys = keys_of(strings)
        order = np.argsort(keys, kind="stable")
        self.strings = [strings[i] for i in order]
        self.verdicts = [verdicts[i] for i in order]
        with open(path, "wb") as f:
            keys[order].tofile(f)
        self.keys = np.memmap(path, dtype=np.uint64, mode="r") if strings else keys

    def find(self, probes: list[bytes]) -> list[str | None]:
        """Each probe's verdict, as "tier:verdict", or None."""
        wanted = keys_of(probes)
        first = np.searchsorted(self.keys, wanted, "left")
        last = np.searchsorted(self.keys, wanted, "right")
        out: list[str | None] = [None] * len(probes)
        for i in np.flatnonzero(last > first):
            fits = [self.verdicts[j] for j in range(first[i], last[i]) if self.strings[j] == probes[i]]
            if fits:
                out[i] = min(fits, key=lambda v: (-int(v.partition(":")[0]), v))  # "allow" before "block"
        return out


def filter_urls(df: DataFrame, entries: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """id, host, path, entry, its tier and verdict (null where none fits) for every row of ``df``.
    ``entries``: host, path, verdict, tier (a whole number)."""
    listed = entries.where("host IS NOT NULL AND host != '' AND path IS NOT NULL AND verdict IS NOT NULL") \
        .select("host", "path", F.concat_ws(":", F.coalesce("tier", F.lit(0)), "verdict").alias("verdict")).distinct()
    n, lengths = listed.agg(F.count("*"), F.collect_set(F.length("path"))).first()  # lengths: at most the longest path
    pages = df.select(col(id_col).alias("id"), host_of(col(url_col).cast("string")).alias("host"),
                      path_of(col(url_col).cast("string")).alias("path"))
    if not n:
        return pages.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("entry"),
                            F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("verdict"))
    # what a page is judged by: its host, and the part of its path that any entry reaches
    reach = F.substring("path", 1, max(lengths))
    pages = pages.withColumn("reach", reach)
    distinct = pages.where("host != ''").select("host", "reach").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix = F.array_distinct(F.filter(F.array(*[F.when(F.length("reach") >= k, F.substring("reach", 1, k))
                                                 for k in sorted(lengths)]), lambda x: x.isNotNull()))
    probes = (distinct.withColumn("suffix", F.explode(suffixes)).where("suffix != ''")
              .withColumn("prefix", F.explode(prefix)).select(
                  "host", "reach", F.concat("suffix", "prefix").alias("probe")))
    shards = -(-n // SHARD_ENTRIES)
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    kept = listed.select(F.concat("host", "path").alias("entry"), "verdict").select(shard("entry"), "entry", "verdict")
    # each shard's entries come first, then its distinct probes
    asked = probes.select("probe").distinct().select(shard("probe"), F.lit(1).alias("kind"),
                                                     F.col("probe").alias("text"), F.lit("").alias("verdict"))
    stream = kept.select("shard", F.lit(0).alias("kind"), F.col("entry").alias("text"), "verdict").unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, verdicts, array = None, [], [], None
        with tempfile.TemporaryDirectory() as folder:  # the task's own, gone with it
            for batch in batches:
                shard_, kind, text, verdict = (batch.column(i).to_pylist() for i in range(4))
                probes_: list[bytes] = []

                def answered() -> Iterator[pa.RecordBatch]:
                    nonlocal array, probes_
                    if probes_:
                        array = array or DigestArray(strings, verdicts, f"{folder}/{held}")
                        found = [(p.decode(), v) for p, v in zip(probes_, array.find(probes_), strict=True) if v]
                        probes_ = []
                        if found:
                            a, b = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["probe", "verdict"])

                for s, k, t, v in zip(shard_, kind, text, verdict, strict=True):
                    if s != held:
                        yield from answered()
                        held, strings, verdicts, array = s, [], [], None
                    if k:
                        probes_.append(t.encode())
                    else:
                        strings.append(t.encode())
                        verdicts.append(v)
                yield from answered()

    hits = (stream.repartition("shard").sortWithinPartitions("shard", "kind")
            .mapInArrow(run, "probe string, verdict string"))
    marks = hits.select("probe", F.split("verdict", ":")[0].cast("int").alias("tier"), F.split("verdict", ":")[1].alias("verdict"))
    best = (probes.join(marks, "probe").groupBy("host", "reach")
            .agg(F.max_by(F.struct("probe", "tier", "verdict"), F.struct("tier", F.length("probe"))).alias("best"))
            .select("host", "reach", "best.*"))
    return pages.join(best, ["host", "reach"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("probe").alias("entry"), "tier", "verdict")
