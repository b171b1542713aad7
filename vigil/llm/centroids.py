"""Centroid clustering in exact integers; the nearest centroid by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their component. A
vector walks all lists outward from its own component, one entry a step in
each; a centroid met for the first time gets its exact squared distance. No
centroid that is still unseen lies nearer than the sum of the squared frontier
distances, so a vector stops once that sum strictly exceeds its best distance
(strictly: an unseen centroid as near as the best could have a smaller number).

Vectors are read once, turned into integers and written under the shared
checkpoint folder. A round is one job: each task adds up its vectors by
cluster, Spark adds the tasks' sums, and k * dims sums come to the driver, which
is all that it holds. Sums travel in limbs of 40 bits, so they are exact for
any finite component.

Defined results: vectors that are null, have another length, or hold a null,
NaN or infinite component are left out. Repeated rows are vectors of their own.
Ties of the starting hash (equal ids) go by the components; a null id is hashed
as empty. Fewer kept vectors than k: all of them are centroids. An empty table
gives an empty result. Only the id and the vector are read, so other columns
may have any name. A distance or sum beyond a 64-bit integer is null; centroids
are exact all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import col, map_batches, staged

#: Vectors that are searched at a time; bounds a task's memory, not the result.
CHUNK = 2048
#: Scaled components below this in size keep all sums of squares in 64 bits.
SMALL = 1 << 26
LIMB, LIMBS = 40, 4
_LONG = 1 << 63


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: int64, or Python integers if any is large."""
    if not values.size or np.abs(values).max() * scale < SMALL:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0 ** 53 else int(v) * scale + int(np.floor((v - int(v)) * scale))
             for v in values.ravel().tolist()]
    out = np.empty(len(exact), dtype=object)
    out[:] = exact
    return out.reshape(values.shape)


class SortedLists:
    """Centroids (k rows of integers) as one sorted list for each dimension."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(v) >= SMALL for row in centroids for v in row)
        self.centroids = np.array(centroids, dtype=object if wide else np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid and squared distance, and how many list entries were read."""
        if x.dtype != self.centroids.dtype:
            x, lists, centroids = x.astype(object), self.values.astype(object), self.centroids.astype(object)
        else:
            lists, centroids = self.values, self.centroids
        n, dims = x.shape
        k = len(centroids)
        far = 1 << 62 if x.dtype != object else 1 << 4096
        dim = np.arange(dims)
        right = np.empty((n, dims), dtype=np.int64)
        for d in range(dims):
            right[:, d] = np.searchsorted(lists[:, d], x[:, d])
        left = right - 1
        label, best = np.zeros(n, dtype=np.int64), np.full(n, far, dtype=x.dtype)
        known = np.full((n, k), far, dtype=x.dtype)
        rows, read = np.arange(n), 0
        for _ in range(k):
            v, lo, hi = x[rows], left[rows], right[rows]
            read += v.size
            below = np.where(lo >= 0, v - lists[np.maximum(lo, 0), dim], far)
            above = np.where(hi < k, lists[np.minimum(hi, k - 1), dim] - v, far)
            down = below <= above
            frontier = np.where(down, below, above)
            met = self.order[np.where(down, lo, hi), dim]
            left[rows], right[rows] = lo - down, hi + ~down
            new = np.zeros((len(rows), k), dtype=bool)
            new[np.arange(len(rows))[:, None], met] = True
            i, c = np.nonzero(new & (known[rows] == far))
            apart = v[i] - centroids[c]
            known[rows[i], c] = (apart * apart).sum(axis=1)
            label[rows] = known[rows].argmin(axis=1)
            best[rows] = known[rows, label[rows]]
            rows = rows[~((frontier * frontier).sum(axis=1) > best[rows]).astype(bool)]
            if not len(rows):
                break
        return label, best, read


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """The batch's vectors in chunks: (first row, integers)."""
    column = batch.column("v")
    dims = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else None
    for start in range(0, len(column), CHUNK):
        yield start, scaled(flat[start:start + CHUNK], scale)


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v) of the vectors with ``dims`` finite components."""
    v = col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dims) & finite)


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha-256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return [scaled(np.array([r["v"]], dtype=np.float64), scale)[0].tolist() for r in rows]


def cluster_sums(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(cluster, dim, n, s0..s3): the vectors of each cluster added up by component, in limbs."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        sums, counts = np.zeros((len(centroids), dims), dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, x in _vectors(batch, scale):
                label, _, _ = lists.nearest(x)
                for c in np.unique(label):
                    sums[c] += x[label == c].sum(axis=0)
                counts += np.bincount(label, minlength=len(centroids))
        full = np.flatnonzero(counts)
        flat = [int(v) for c in full for v in sums[c]]
        low = [[(v >> (LIMB * i)) & ((1 << LIMB) - 1) for v in flat] for i in range(LIMBS - 1)]
        top = [v >> (LIMB * (LIMBS - 1)) for v in flat]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(full)), pa.int32()),
             pa.array(np.repeat(counts[full], dims), pa.int64()), *(pa.array(x, pa.int64()) for x in [*low, top])],
            names=["cluster", "dim", "n", *(f"s{i}" for i in range(LIMBS))])

    schema = "cluster int, dim int, n long, " + ", ".join(f"s{i} long" for i in range(LIMBS))
    return map_batches(kept, run, schema).groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(LIMBS)))


def assign(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(id, cluster, distance) of every kept vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for start, x in _vectors(batch, scale):
                label, best, _ = lists.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(x)), pa.array(label, pa.int32()),
                     pa.array([v if v < _LONG else None for v in best.tolist()], pa.int64())],
                    names=["id", "cluster", "distance"])

    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return map_batches(kept, run, schema)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10,
                    dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """Id, cluster, squared distance, sums of it by cluster and over all, and the centroid's digest."""
    kept = staged(kept_vectors(df, id_col, vec_col, dims), "vectors")
    out = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    centroids = first_centroids(kept, k, scale, seed)
    if not centroids:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in out[1:4]),
                           F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        for r in cluster_sums(kept, centroids, scale).collect():  # k * dims rows
            centroids[r["cluster"]][r["dim"]] = sum(r[f"s{i}"] << (LIMB * i) for i in range(LIMBS)) // r["n"]
    found = staged(assign(kept, centroids, scale), "clusters")
    whole = F.col("distance").cast("decimal(38,0)")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(whole))
    by_cluster = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    fits = lambda v: int(v) if v is not None and v < _LONG else None
    over_all = fits(None if None in by_cluster.values() else sum(by_cluster.values()))
    facts = df.sparkSession.createDataFrame(
        [(c, fits(v), over_all, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in by_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *out)


def cluster_sql(table: str = "embeddings", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same in DuckDB SQL, each round a step of its own and every distance computed."""
    near = lambda c: f"""SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
            SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
            FROM x CROSS JOIN {c}) GROUP BY r"""  # noqa: E731
    steps = [f"""x AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v
            FROM {table} WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (
                SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM x ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({near(f"c{i}")}),
        c{i + 1} AS MATERIALIZED (
            SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS m FROM (
                    SELECT c, d, sum(v[d]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {dims + 1}) t(d) GROUP BY c, d)
                GROUP BY c) n ON n.c = c{i}.c)""")
    return f"""WITH {", ".join(steps)},
        last AS MATERIALIZED ({near(f"c{rounds}")})
        SELECT vec_id, c::INT AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM last JOIN c{rounds} USING (c)"""
