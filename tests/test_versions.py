"""Version order and interval matching against plain versions."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from vigil.functions.versions import version_key
from vigil.operators import deps

NPM = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0",
       "1.0.0.0.1", "1.0.1-0", "1.2.0-beta.1", "1.2", "1.2.0.1", "1.10.0", "9.9.9", "10.0.0", "2024010112345.1", "2024010112345.1.1",
       "99999999999999999999999999.0"]
PYPI = ["0.1.dev1", "0.1a1.dev2", "0.1a1", "0.1a1.post1", "0.1a2", "0.1b1", "0.1rc1", "0.1", "0.1.post1.dev3", "0.1.post1", "0.1.post12", "0.2", "1!0.0.1"]
SAME = [("npm", "1.2", "1.2.0.0"), ("npm", "v1.2.0", "1.2.0+build.7"), ("npm", "01.002", "1.2"), ("PyPI", "1.0-ALPHA1", "1.0a1"),
        ("PyPI", "1.0.0", "1"), ("PyPI", "1.0-1", "1.0.post1"), ("PyPI", "1.0c2", "1.0rc2")]


def keys(spark, rows):
    df = spark.createDataFrame([(i, e, v) for i, (e, v) in enumerate(rows)], "i int, e string, v string")
    return [r.k for r in df.select("i", version_key(F.col("v"), F.col("e")).alias("k")).orderBy("i").collect()]


def test_order(spark):
    for ecosystem, order in (("npm", NPM), ("PyPI", PYPI)):
        got = keys(spark, [(ecosystem, v) for v in order])
        assert all(a < b for a, b in pairwise(got)), [x for x, (a, b) in zip(pairwise(order), pairwise(got)) if a >= b]
    got = keys(spark, [(e, v) for e, a, b in SAME for v in (a, b)])
    assert got[::2] == got[1::2]


def plain(v):
    """A semantic version as something Python compares."""
    core, _, pre = v.partition("+")[0].partition("-")
    parts = [int(p) for p in core.split(".")]
    while parts and parts[-1] == 0:
        parts.pop()
    ids = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")] if pre else []
    return parts, not ids, ids


def random_version(rng):
    core = ".".join(str(rng.choice([0, 0, 1, 2, 10, 2 ** 40])) for _ in range(rng.randrange(1, 6)))
    pre = ".".join(rng.choice(["alpha", "rc", "0", "1", "11", "a-b"]) for _ in range(rng.randrange(3)))
    return core + (f"-{pre}" if pre else "")


def test_pairs_against_a_plain_comparison(spark):
    rng = random.Random(4)
    versions = [random_version(rng) for _ in range(2000)]
    got = keys(spark, [("npm", v) for v in versions])
    for a, b, x, y in zip(versions[::2], versions[1::2], got[::2], got[1::2], strict=True):
        assert (x < y, x == y) == (plain(a) < plain(b), plain(a) == plain(b)), (a, b)


def test_intervals_against_every_pair(spark):
    """Overlapping intervals with all kinds of ends, for packages of one to hundreds of versions."""
    rng = random.Random(5)
    versions = sorted({(f"p{rng.randrange(4)}", random_version(rng)) for _ in range(400)})
    advisories, want = [], set()
    for i in range(120):
        name, events, spans = f"P{rng.randrange(5)}", [], []
        for _ in range(rng.randrange(1, 3)):
            lo, hi, kind = rng.choice([None, random_version(rng)]) if not events else random_version(rng), random_version(rng), rng.choice(["fixed", "last_affected", None])
            if lo:
                events.append((lo, None, None))
            if kind:
                events.append((None, hi, None) if kind == "fixed" else (None, None, hi))
            spans.append((lo, hi, kind))
            if not lo or not kind:
                break
        if spans and not spans[0][0] and not spans[0][2]:
            events = []
        advisories.append((f"a{i}", [((name, "npm"), [("SEMVER", events)], ["7.7.7"])]))
        for n, v in versions:
            inside = any((lo is None or plain(v) >= plain(lo)) and (kind is None or plain(v) < plain(hi) or kind == "last_affected" and plain(v) == plain(hi))
                         for lo, hi, kind in spans)
            if n == name.lower() and inside:
                want.add((n, v, f"a{i}"))
    schema = ("id string, affected array<struct<package: struct<name: string, ecosystem: string>, ranges: array<struct<type: string, "
              "events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>")
    packages = spark.createDataFrame([("npm", n, v) for n, v in [*versions, ("p0", "7.7.7")]], "ecosystem string, name string, version string")
    got = {(r.name, r.version, r.adv_id) for r in deps.sca_match(packages, spark.createDataFrame(advisories, schema)).collect()}
    assert {g for g in got if g[1] != "7.7.7"} == want
    assert {a for n, v, a in got if v == "7.7.7"} >= {i for i, [((n, _), _, _)] in advisories if n == "P0"}


def test_blocks_cover_each_point_once(spark):
    df = spark.range(0, 21).alias("a").crossJoin(spark.range(0, 21).selectExpr("id AS hi")).selectExpr("id AS lo", "hi")
    n = F.lit(20).cast("long")
    cover = df.select("lo", "hi", F.explode(deps.covering_blocks(F.col("lo"), F.col("hi"), n)).alias("x"))
    points = spark.range(0, 20).select(F.col("id").alias("p"), F.explode(deps.blocks_of(F.col("id"), n)).alias("x"))
    got = sorted((r.lo, r.hi, r.p) for r in cover.join(points, "x").collect())
    assert got == sorted((lo, hi, p) for lo in range(21) for hi in range(21) for p in range(lo, min(hi, 20)))


def test_a_package_of_many_projects_is_dealt_evenly(spark):
    packages = spark.range(4000).selectExpr("'npm' AS ecosystem", "'left' AS name", "'1.0.0' AS version", "concat('q', id) AS project")
    shares = packages.groupBy(F.pmod(F.xxhash64("project"), F.lit(deps.SPLIT)).alias("part")).count().collect()
    assert len(shares) == deps.SPLIT and max(r["count"] for r in shares) < 1.3 * 4000 / deps.SPLIT
