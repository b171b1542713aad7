"""Property checks: masking, entropy bounds, score range, one primary per group."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions.entropy import mask_value, shannon_entropy
from vigil.functions.severity import security_score

ALNUM = st.text(alphabet="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", min_size=0, max_size=60)


@settings(max_examples=1, deadline=None)
@given(st.lists(ALNUM, min_size=20, max_size=40))
def test_mask_and_entropy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", mask_value(F.col("v")).alias("m"), shannon_entropy(F.col("v")).alias("h")).collect()
    for r in rows:
        if len(r.v) > 8:
            assert r.m != r.v and r.m[:4] == r.v[:4] and r.m[-4:] == r.v[-4:]
        else:
            assert r.m == "****"
        assert 0.0 <= r.h <= (math.log2(len(r.v)) + 1e-9 if r.v else 0.0)
        if r.v:
            counts = [r.v.count(c) for c in set(r.v)]
            expect = -sum(c / len(r.v) * math.log2(c / len(r.v)) for c in counts)
            assert abs(r.h - expect) < 1e-9


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 30)] * 5), min_size=10, max_size=30))
def test_score_range(spark, counts):
    df = spark.createDataFrame(counts, "c long, h long, m long, l long, i long")
    for r in df.select(security_score("c", "h", "m", "l", "i").alias("s"), "c", "h", "m", "l", "i").collect():
        raw = 100 - (20 * r.c + 10 * r.h + 3 * r.m + r.l + 0.5 * r.i)
        assert r.s == math.floor(max(0.0, min(100.0, raw)) + 0.5) and 0 <= r.s <= 100


def test_one_primary_per_group(spark):
    from vigil.plans.q_core import corpus_of
    from vigil.operators import triage
    c = corpus_of(spark, "/root/testdata/sf0.001")
    t = triage.dedup_flags(c.findings).withColumn("k", triage.dedup_key()).withColumn("scan", triage.scan_scope(c.findings))
    per = t.groupBy("project", "scan", "k").agg(F.count_if(~F.col("is_duplicate")).alias("primaries"))
    assert per.where(F.col("primaries") != 1).count() == 0
    bad = t.where(F.col("is_duplicate") & F.col("duplicate_of").isNull()).count()
    assert bad == 0


def test_salted_dedup_equals_unsalted(spark):
    from vigil.plans.q_core import corpus_of
    from vigil.operators import triage
    f = corpus_of(spark, "/root/testdata/sf0.001").findings
    plain = triage.dedup_flags(f, salts=1).select("id", "is_duplicate", "duplicate_of")
    salted = triage.dedup_flags(f, salts=7).select("id", "is_duplicate", "duplicate_of")
    assert salted.count() == plain.count() == f.count()
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    # groups of several rows do occur at this scale
    assert triage.dedup_groups(f).where(F.col("total_count") > 3).count() > 0


def test_dedup_shuffles_findings_once(spark):
    """Whatever groups count as hot, flags and groups are the same, and findings are shuffled once."""
    from vigil.plans.q_core import corpus_of
    from vigil.operators import triage
    f = corpus_of(spark, "/root/testdata/sf0.001").findings
    f = f.unionByName(f.withColumn("id", F.concat("id", F.lit("-again"))).withColumn("scan_ts", F.lit(None).cast("timestamp")))
    seen = {}
    for hot in (1, 3, triage.HOT_ROWS):
        flags = triage.dedup_flags(f, salts=5, hot_rows=hot)
        seen[hot] = (sorted(map(tuple, flags.select("id", "is_duplicate", "duplicate_of").fillna("").collect())),
                     sorted(map(tuple, triage.dedup_groups(f, hot_rows=hot).collect())))
    assert seen[1] == seen[3] == seen[triage.HOT_ROWS]
    assert any(r[-1] > 3 for r in seen[1][1])
    plan = triage.dedup_flags(f)._jdf.queryExecution().executedPlan().toString()
    # one for the findings, one for the sketch, one for the hot groups
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_findings_alone_in_their_group_are_not_shuffled(spark):
    """Only findings whose group may have others meet by group; how many more share a bit with these changes no flag."""
    from vigil.plans.q_core import corpus_of
    from vigil.operators import triage
    f = corpus_of(spark, "/root/testdata/sf0.001").findings
    f = f.unionByName(f.withColumn("scan_ts", F.lit(None).cast("timestamp")).withColumn("project", F.lit(None).cast("string")))
    sizes = [r.total_count for r in triage.dedup_groups(f).collect()]
    assert sizes.count(1) > 5000 and max(sizes) > 1
    alone, met, _ = triage._grouped(f, triage.HOT_ROWS)
    assert met.count() < 1.05 * sum(n for n in sizes if n > 1) and alone.count() + met.count() == f.count()
    seen = set()
    for words in (1, 4, triage.SHARED_WORDS):
        assert words > 1 or triage._grouped(f, triage.HOT_ROWS, words)[0].count() == 0
        flags = triage.dedup_flags(f, words=words).select("id", "project", "is_duplicate", "duplicate_of").fillna("")
        seen.add(str((sorted(map(tuple, flags.collect())), sorted(map(str, triage.dedup_groups(f, words=words).collect())))))
    assert len(seen) == 1


def _stored(spark, rows):
    """Dependency findings (id, month, cve) of one project, in the findings schema."""
    from vigil.schemas import conform
    df = spark.createDataFrame(rows, "id string, month string, cve string")
    return conform(df.select(
        "id", F.lit("p").alias("project"), F.lit("sca").alias("scanner"), F.lit("vulnerable-dependency").alias("rule"),
        F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit("/package.json").alias("path"),
        F.lit(1).alias("line"), "cve", F.lit("left").alias("package_name"), F.lit("1.0.0").alias("installed_version"),
        F.to_timestamp(F.concat("month", F.lit("-05 00:00:00"))).alias("scan_ts")))


def test_scans_are_judged_apart(spark):
    """A finding present in two scans counts in both, and a repaired CVE shows as fixed."""
    from vigil.operators import reports, triage
    f = _stored(spark, [("a1", "2024-01", "CVE-1"), ("a2", "2024-01", "CVE-2"), ("a3", "2024-01", "CVE-2"),
                        ("b1", "2024-02", "CVE-1"), ("c1", "2024-03", "CVE-1"), ("c2", "2024-03", "CVE-3")])
    flags = {r.id: r.duplicate_of for r in triage.dedup_flags(f).collect()}
    assert flags == {"a1": None, "a2": None, "a3": "a2", "b1": None, "c1": None, "c2": None}
    tri = triage.dedup_flags(f).withColumn("auto_ignored", F.lit(False)).withColumn("contextual_severity", F.lit(None).cast("string"))
    status = sorted((r.scan_no, r.status) for r in reports.status_diff(tri).collect())
    assert status == [(2, "fixed"), (2, "open"), (3, "new"), (3, "open")]
    assert [r.high for r in reports.trend(tri).orderBy("scan_ts").collect()] == [2, 1, 2]


def test_every_interval_of_a_range(spark):
    """A range with two intervals, one open below, one open above, and commits, which are no versions."""
    from vigil.operators import deps

    def adv(name, kind, events):
        pairs = ", ".join(f"named_struct('introduced', {i}, 'fixed', {x})" for i, x in events)
        return (f"SELECT '{name}' AS id, array(named_struct('package', named_struct('ecosystem', 'npm', 'name', 'left'), "
                f"'ranges', array(named_struct('type', '{kind}', 'events', array({pairs}))), "
                "'versions', CAST(NULL AS array<string>))) AS affected")
    none = "CAST(NULL AS string)"
    two = [("'0'", none), (none, "'1.2.0'"), ("'2.0.0'", none), (none, "'2.3.0'")]
    advisories = spark.sql(" UNION ALL ".join([
        adv("two", "SEMVER", two), adv("below", "SEMVER", [(none, "'1.1.0'")]), adv("above", "SEMVER", [("'2.1.0'", none)]),
        adv("commits", "GIT", two)]))
    packages = spark.sql("SELECT 'npm' AS ecosystem, 'Left' AS name, explode(array('1.0.0', '1.2.0', '2.1.0', '2.3.0')) AS version")
    found = sorted((r.version, r.adv_id) for r in deps.sca_match(packages, advisories).collect())
    assert found == [("1.0.0", "below"), ("1.0.0", "two"), ("2.1.0", "above"), ("2.1.0", "two"), ("2.3.0", "above")]


def test_counts_without_a_row_for_each_finding(spark):
    """Counts by package version equal the findings counted, where intervals of an advisory overlap, meet, are empty, and where
    listed versions lie inside or outside of them or share their rank with another text."""
    from vigil.operators import deps
    from vigil.schemas import ADVISORIES

    def adv(name, ranges, versions, score):
        events = [{"type": "SEMVER", "events": [{"introduced": i, "fixed": x, "last_affected": None} for i, x in r]} for r in ranges]
        return {"id": name, "aliases": [], "severity": [], "references": [], "database_specific": {"cvss_score": score},
                "affected": [{"package": {"name": "Left", "ecosystem": "npm"}, "ranges": events, "versions": versions}]}
    advisories = spark.createDataFrame([
        adv("overlap", [[("0", None), (None, "1.5.0")], [("1.0.0", None), (None, "2.0.0")]], ["1.2.0"], 9.5),
        adv("meet", [[("1.0.0", None), (None, "1.5.0"), ("1.5.0", None), (None, "2.0.0")]], ["3.0"], 9.1),
        adv("empty", [[("2.0.0", None), (None, "1.0.0")]], ["3.0.0", "1.2"], 7.5),
        adv("open", [[("1.2.0", None)]], [], 2.0)], ADVISORIES)
    rows = [(f"p{i % 3}", "npm", "left", v, False, True) for i, v in enumerate(
        ["0.1.0", "1.0.0", "1.2", "1.2.0", "1.5.0", "2.0.0", "3.0", "3.0.0", "1.2.0-beta"] * 2)]
    packages = spark.createDataFrame(rows, "project string, ecosystem string, name string, version string, is_dev boolean, is_direct boolean").distinct()
    found = deps.sca_findings(packages, advisories).groupBy("project", "package_name", "is_dev_dependency", "is_reachable", "severity").count()
    counted = deps.project_counts(packages, advisories)
    want = sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, counted.collect())) == want and sum(r[-1] for r in want) == 20
