"""Finding life cycle, distributed ranks and compose files of any layout."""

import random
import re

from pyspark.sql import functions as F

from vigil.operators import config, reach, reports, triage
from vigil.schemas import conform
from vigil.session import checkpoint_table


def stored(spark, rows):
    """Findings (project, scan time, cve, ignored) in the triaged schema."""
    df = spark.createDataFrame(rows, "project string, ts string, cve string, auto_ignored boolean")
    found = conform(df.select(
        F.expr("uuid()").alias("id"), "project", F.lit("sca").alias("scanner"), F.lit("r").alias("rule"), F.lit("high").alias("severity"),
        F.lit("high").alias("confidence"), F.lit("/p").alias("path"), F.lit(1).alias("line"), "cve", F.to_timestamp("ts").alias("scan_ts")))
    ignored = spark.createDataFrame(rows, "project string, ts string, cve string, auto_ignored boolean").select("cve", "auto_ignored", F.to_timestamp("ts").alias("scan_ts"), "project")
    return found.join(ignored, ["project", "cve", "scan_ts"]).withColumn("is_duplicate", F.lit(False)).withColumn(
        "contextual_severity", F.lit(None).cast("string"))


SCANS = ["2024-01-03 10:00:00", "2024-01-03 18:00:00", "2024-02-01 10:00:00", "2024-02-09 10:00:00"]  # two on one day


def test_life_cycle(spark):
    seen = {"stays": "1111", "fixed": "1100", "back": "1011", "twice back": "1010", "late": "0001", "hidden": "11ii", "was hidden": "i100"}
    rows = [("p", SCANS[k], name, mark == "i") for name, marks in seen.items() for k, mark in enumerate(marks) if mark != "0"]
    rows += [("q", SCANS[0], "alone", False), ("p", SCANS[2], "x", False), ("p", SCANS[3], "x", False)]
    tri = stored(spark, rows)
    names = {r.fp: r.cve for r in tri.select(reports.fingerprint().alias("fp"), "cve").distinct().collect()}
    life = {names[r.fp]: (r.status, r.first_scan, r.last_scan, r.reopened) for r in reports.life_cycle(tri).collect()}
    assert life == {"stays": ("open", 1, 4, 0), "fixed": ("fixed", 1, 2, 0), "back": ("open", 1, 4, 1), "twice back": ("fixed", 1, 3, 1),
                    "late": ("open", 4, 4, 0), "hidden": ("ignored", 1, 4, 0), "was hidden": ("fixed", 1, 2, 0), "alone": ("open", 1, 1, 0),
                    "x": ("open", 3, 4, 0)}
    status = {(names[r.fp], r.scan_no): r.status for r in reports.status_diff(tri).where("project = 'p'").collect()}
    assert [status.get(("back", k)) for k in (2, 3, 4)] == ["fixed", "reopened", "open"]
    assert [status.get(("twice back", k)) for k in (2, 3, 4)] == ["fixed", "reopened", "fixed"]
    assert [status.get(("hidden", k)) for k in (2, 3, 4)] == ["open", "ignored", "ignored"]
    assert status["late", 4] == "new" and ("fixed", 4) not in status and status["fixed", 3] == "fixed"
    assert reports.trend(tri).where("project = 'p'").count() == 4  # scans of one day stay two
    runs = sorted((names[r.fp], r.first_scan, r.last_scan) for r in reports.islands(tri).collect() if names[r.fp] == "twice back")
    assert runs == [("twice back", 1, 1), ("twice back", 3, 3)]


def test_a_finding_meets_its_scans_in_one_shuffle(spark):
    """Projects in parts or whole, the scans of a finding are the same, and rows are shuffled once for all of it."""
    rows = [(p, SCANS[i % 4], f"c{(i * 7 + j) % 11}", j == 0) for p in ("p", "q") for i in range(8) for j in range(3) if (i, p) != (3, "q")]
    tri = stored(spark, rows)
    tri = checkpoint_table(spark, tri, "life")
    plain, dealt = reports.presence(tri), reports.presence(tri, hot_rows=1, parts=5)
    assert plain.count() > 40 and {r.part for r in dealt.select("part").distinct().collect()} == set(range(5))
    assert sorted(map(str, plain.drop("part").collect())) == sorted(map(str, dealt.drop("part").collect()))
    plan = reports.life_cycle(tri)._jdf.queryExecution().executedPlan().toString()
    # the findings, and the time stamps of the projects in parts
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_duplicates_are_judged_within_a_scan(spark):
    tri = stored(spark, [("p", SCANS[0], "c", False), ("p", SCANS[1], "c", False)])
    assert triage.dedup_flags(tri).where("is_duplicate").count() == 0


def test_pages(spark):
    files = [f"/src/f{i:05d}.ts" for i in range(2345)]
    rows = [("p", "lodash", f, i % 2 == 0) for i, f in enumerate(files)] + [("p", "axios", "/a.ts", False)] * 3
    imps = spark.createDataFrame(rows, "project string, package string, file string, risky_used boolean").repartition(6)
    pages = {(r.package, r.page): r.files for r in reach.import_map(imps, 500).collect()}
    assert [len(pages["lodash", k]) for k in (1, 2, 3, 4, 5)] == [500, 500, 500, 500, 345]
    assert sum((pages["lodash", k] for k in range(1, 6)), []) == files and pages["axios", 1] == ["/a.ts"]
    assert {r.n_files for r in reach.import_map(imps, 500).where("package = 'lodash'").collect()} == {2345}


def test_lookup_reads_few_buckets(spark):
    found = spark.range(3000).selectExpr("concat('id', id) AS id", "concat('p', id % 3) AS project", "'m' AS message")
    table = reports.store_findings(found, "found")
    ids = [f"id{i}" for i in range(0, 3000, 300)]
    some = reports.lookup(spark, table, ids)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say
    plan = some._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    selected = int(re.search(r"SelectedBucketsCount: (\d+) out of 64", plan)[1])
    assert selected <= len(ids) and sorted(r.id for r in some.collect()) == sorted(ids)
    joined = reports.lookup(spark, table, spark.createDataFrame([(i,) for i in [*ids, "none"]], "id string").hint("merge"))
    assert sorted(r.id for r in joined.collect()) == sorted(ids)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin"):plan.index("SelectedBucketsCount")]
    assert "Exchange" not in stored  # the stored side stays where it is


def test_scanners_are_lazy(make_files, monkeypatch):
    from vigil.plans import scan
    plan = scan.ScanPlan(make_files([("p", "/a.js", "eval(x)")]), None, scanners=("sast",), stage_as="raw")
    assert plan.detected.count() == 1 and "raw_findings" not in plan.__dict__


def test_rank(spark):
    rng = random.Random(3)
    rows = [("big" if rng.random() < 0.4 else f"p{rng.randrange(30)}", rng.randrange(4), f"id{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "project string, priority_score int, id string").repartition(7)
    got = {r.id: r["rank"] for r in triage.priority_rank(df).collect()}
    want = {}
    for project in {r[0] for r in rows}:
        for k, r in enumerate(sorted((-s, i) for p, s, i in rows if p == project), 1):
            want[r[1]] = k
    assert got == want
    assert triage.priority_rank(df.limit(0)).count() == 0


WIDE = """services:   # comment
    web:
        image: "a#b"
        privileged: true # for now
        ports: ["5432", '80:80', "0.0.0.0:9:9"]   # flow
        environment: {API_KEY: abc, MODE: "x # y"}
    "db":
        ports:
        - 6379
        - "127.0.0.1:1:1"
        environment:
            DB_PASSWORD: 's3cret'
            DB_TOKEN:
            SAFE: ${DB_SECRET}
    many:
        ports: [
            "7000",
            "0.0.0.0:8000:8000"
        ]
        privileged: "true"
volumes:
    ports:
        - 1234
"""
NARROW = """version: '3'
services:
 a:
  privileged: true
  environment:
   - SECRET=x
   - PLAIN=y
  ports:
   - 22
"""


def test_compose_layouts(make_files):
    files = make_files([("p", "/docker-compose.yml", WIDE), ("p", "/x/docker-compose.yml", NARROW), ("p", "/y/docker-compose.yml", "services:\n"),
                        ("p", "/z/docker-compose.yml", "# " + "long prose 'with quotes " * 20_000 + "\nservices:\n  a:\n    privileged: true\n")])
    found = config.config_findings(files).where(F.col("rule").startswith("compose")).select("path", "rule", "line", "message").collect()
    short = {"compose-privileged-container": "priv", "compose-port-exposure": "port", "compose-hardcoded-secret": "env"}
    got = sorted((r.path[1], short[r.rule], r.line) for r in found)
    assert got == sorted([("d", "priv", 4), ("d", "port", 5), ("d", "port", 5), ("d", "env", 6), ("d", "port", 9), ("d", "env", 12), ("d", "env", 13),
                          ("d", "port", 17), ("d", "port", 18), ("x", "priv", 4), ("x", "env", 6), ("x", "port", 9), ("z", "priv", 4)])
    assert any("'db' exposes port 6379" in r.message for r in found)
