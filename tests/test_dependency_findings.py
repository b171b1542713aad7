"""Dependency findings: every value from the advisory, nothing twice, and no shuffle of the findings themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.operators import deps, reach
from vigil.schemas import ADVISORIES, PACKAGES

VERSIONS = ["0.1.0", "1.0.0", "1.2", "1.2.0", "1.5.0", "2.0.0", "3.0", "3.0.0", "1.2.0-beta"]


def advisory(i, name, ecosystem, ranges, versions, score, cve):
    events = [{"type": "SEMVER", "events": [{"introduced": lo, "fixed": hi, "last_affected": None} for lo, hi in r]} for r in ranges]
    return {"id": f"a{i}", "aliases": [cve] if cve else [], "summary": f"s{i}", "details": None, "severity": [], "references": [],
            "database_specific": {"severity": None, "cvss_score": score, "cwe_ids": None},
            "affected": [{"package": {"name": name, "ecosystem": ecosystem}, "ranges": events, "versions": versions}]}


@pytest.fixture(scope="module")
def corpus(spark):
    """Overlapping intervals, listed versions inside and outside of them, CVEs of several advisories, names and versions of
    several ecosystems, the same package twice in a project."""
    rng = random.Random(8)
    advisories, packages = [], set()
    for i in range(40):
        ranges = [[(rng.choice(VERSIONS), None), (None, rng.choice(VERSIONS))] for _ in range(rng.randrange(1, 4))]
        cve = rng.choice([None, f"CVE-2024-{rng.randrange(12)}"])
        advisories.append(advisory(i, rng.choice(["Left", "right", "lodash"]), rng.choice(["npm", "PyPI"]), ranges,
                                   rng.sample(VERSIONS, 2), rng.choice([None, 2.5, 3.5, 5.0, 7.5, 9.5]), cve))
    for _ in range(120):
        packages.add((f"p{rng.randrange(6)}", rng.choice(["npm", "PyPI"]), rng.choice(["left", "LEFT", "right", "lodash"]),
                      rng.choice(VERSIONS), rng.random() < 0.3, True))
    return spark.createDataFrame(sorted(packages), PACKAGES), spark.createDataFrame(advisories, ADVISORIES)


def above_findings(df):
    """The plan from its result down to the join that makes the findings."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return lines[:next(i for i, line in enumerate(lines) if re.search(r"(SortMerge|Hash)Join.*part#", line))]


def test_facts_travel_with_the_intervals(corpus):
    packages, advisories = corpus
    facts = deps.advisory_facts(advisories).select("adv_id", "name_lc", "cve", "cvss")
    plain = deps.sca_match(packages, advisories)
    with_facts = deps.sca_match(packages, advisories, facts)
    assert plain.count() == plain.distinct().count() > 100
    joined = plain.withColumn("name_lc", F.lower("name")).join(facts, ["adv_id", "name_lc"]).select(with_facts.columns)
    assert sorted(map(str, with_facts.collect())) == sorted(map(str, joined.collect()))


def test_cves_of_projects_without_shuffling_findings(corpus):
    packages, advisories = corpus
    want = deps.sca_findings(packages, advisories).select("project", "package_name", "installed_version", "cve")
    got = deps.sca_cves(packages, advisories)
    assert want.count() > want.distinct().count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.distinct().collect()))
    assert not [line for line in above_findings(got) if "Exchange" in line]


def test_cves_of_package_versions_are_shuffled_once(spark, corpus):
    """The advisories of a CVE are matched as one, so nothing has to be made distinct after versions multiply them."""
    packages, advisories = corpus
    found = deps.sca_match(packages, deps._by_cve(advisories))
    both = deps.sca_match(packages, advisories, deps.advisory_facts(advisories).select("adv_id", "name_lc", "cve")).select(
        "ecosystem", "name", "version", "cve")
    assert found.count() == found.distinct().count() < both.count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, both.distinct().collect()))
    plan = deps.sca_cves(packages, advisories)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name") == 2  # CVEs of package versions, and packages, to where they meet


def test_cves_meet_projects_by_equality(corpus):
    """Sets of ecosystems are compared for names and versions of several ecosystems only, not for every CVE of a project; and what
    the join makes is not left to a few tasks because little goes in."""
    packages, advisories = corpus
    got = deps.sca_cves(packages, advisories)
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"(SortMerge|Hash)Join.*part#", line)]
    assert len(joins) == 2 and "ecosystem#" in joins[0] and "overlap" not in joins[0] and "overlap" not in joins[1].split("Inner")[0]
    assert got.rdd.getNumPartitions() >= 8


def test_reachability_is_decided_before_advisories(spark, corpus, make_files):
    packages, advisories = corpus
    files = make_files([(f"p{i}", f"/src/{i}.js", body) for i, body in enumerate(
        ["import x from 'left'", "import _ from 'lodash'; _.merge(a, b)", "require('lodash')", "require('right/a')", "", "x"])])
    cols = ["id", "project", "package_name", "is_reachable", "reachability_reason"]
    want = reach.reachability(deps.sca_findings(packages, advisories), files).select(cols)
    got = deps.sca_findings(reach.package_reachability(packages, files), advisories, conform_schema=False).select(cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.is_reachable for r in got.select("is_reachable").distinct().collect()} == {True, False}
    assert not [line for line in above_findings(got) if "Exchange" in line]


@pytest.mark.parametrize("key", ["reachability", "sca_cve", "sca_exploit", "sca_fixed_version", "sca_vulnerable_range", "sca_findings"])
def test_queries_do_not_shuffle_findings(spark, key):
    from vigil.plans.queries import load_all
    df = load_all()[key].build(spark, "/root/testdata/sf0.001")
    assert not [line for line in above_findings(df) if "Exchange" in line]
    # the advisories' side is shuffled once, not repeated for each part
    assert not re.search(r"Generate explode\(\[0,1,2,3,4,5,6,7\]\).*adv_id", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("shared", [True, False])
def test_summary_counts_as_triaged_one_by_one(spark, corpus, make_files, shared):
    """Counted dependency findings and those triaged one by one: CVEs of several advisories, of the same or of different severity,
    with and without exploits, packages twice in a project, development dependencies, unused packages."""
    import json

    from vigil.operators import triage
    from vigil.plans.scan import ScanPlan
    rng = random.Random(9)
    advisories = []
    for i in range(60):
        name = rng.choice(["left", "right", "lodash"])
        a = advisory(i, name, "npm", [[(rng.choice(VERSIONS), None)]], [], rng.choice([2.5, 3.5, 5.0, 7.5, 9.5]),
                     f"CVE-2024-{rng.randrange(25)}" + ("" if shared else f"-{name}-{i % 3}"))
        a["references"] = [{"type": rng.choice(["WEB", "EVIDENCE"]), "url": "u"}]
        advisories.append(a)
    advisories = spark.createDataFrame(advisories, ADVISORIES)
    files = []
    for p in range(12):
        deps_ = {n: rng.choice(VERSIONS) for n in rng.sample(["left", "right", "lodash"], rng.randrange(1, 4))}
        dev = {n: rng.choice(VERSIONS) for n in rng.sample(["left", "right", "lodash"], rng.randrange(3))}
        files.append((f"p{p}", "/package.json", json.dumps({"dependencies": deps_, "devDependencies": dev})))
        files.append((f"p{p}", "/src/a.js", "import x from 'left'\neval(x)" if p % 2 else "import x from 'right'"))
    files = make_files(files)
    context = spark.createDataFrame([], "project string, has_database boolean, is_publicly_deployed boolean, frameworks array<string>")
    plan = ScanPlan(files, advisories, scanners=("sca",), context=context)
    packages = reach.package_reachability(deps.packages_from_manifests(files), files)
    counts = deps.sca_decided(packages, advisories)[0].groupBy("is_duplicate").agg(F.sum("n")).collect()
    tri = triage.dedup_flags(triage.apply_context(plan.detected, plan.context)).cache()
    cols = ["project", "severity", "contextual_severity", "auto_ignored", "is_duplicate"]
    counted = plan._triaged_counts().groupBy(*cols).agg(F.sum("n"))
    assert sum(r[1] for r in counts) > 30 and (shared or len(counts) == 2) and sum(r[1] for r in counts) < tri.count() - 30
    assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, map(tuple, tri.groupBy(*cols).count().collect())))


def test_answers_are_not_shuffled(spark, corpus):
    """A package lookup says each thing once: advisories that say the same of a package, on overlapping intervals and in several
    ecosystems, and names and versions that several ecosystems have."""
    packages, advisories = corpus
    rng = random.Random(10)
    same = []
    for i in range(60):
        a = advisory(100 + i, rng.choice(["left", "Right"]), rng.choice(["npm", "PyPI"]), [[(rng.choice(VERSIONS), None)]], rng.sample(VERSIONS, 1),
                     rng.choice([5.0, 7.5]), f"CVE-2024-{rng.randrange(3)}")
        a["affected"].append({**a["affected"][0], "package": {"name": rng.choice(["LEFT", "lodash"]), "ecosystem": "PyPI"}})
        same.append({**a, "summary": rng.choice(["s", "", None])})
    advisories = advisories.unionByName(spark.createDataFrame(same, ADVISORIES))
    pk = packages.select("ecosystem", "name", "version").distinct()
    got = deps.check_package(advisories, pk, answers=True)
    findings = deps.check_package(advisories, pk).select(got.columns)
    want = sorted(map(str, findings.distinct().collect()))
    assert len(want) < findings.count() - 100
    assert sorted(map(str, got.collect())) == want
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in lines[:next(i for i, line in enumerate(lines) if "Join" in line)] if "Exchange" in line]


def test_summary_reads_manifests_once(spark, make_files):
    """What is read many times is written once, and the findings triaged one by one ask for the packages and advisories that can
    meet there only: crowded packages, CVEs of several packages, advisories of several packages."""
    import json

    from vigil.plans.scan import ScanPlan
    rng = random.Random(11)
    advisories = []
    for i in range(40):
        a = advisory(i, rng.choice(["left", "right", "lodash", "other"]), "npm", [[(rng.choice(VERSIONS), None)]], rng.sample(VERSIONS, 1),
                     rng.choice([2.5, 5.0, 9.5]), rng.choice([None, f"CVE-2024-{rng.randrange(30)}"]))
        if i % 5 == 0:
            a["affected"].append({**a["affected"][0], "package": {"name": "Right", "ecosystem": "npm"}})
        advisories.append(a)
    advisories.append({**advisories[1], "id": "none", "affected": []})
    advisories = spark.createDataFrame(advisories, ADVISORIES)
    files = []
    for p in range(12):
        names = rng.sample(["left", "LEFT", "right", "Right", "lodash"], rng.randrange(1, 5))
        files.append((f"p{p}", "/package.json", json.dumps({"dependencies": {n: rng.choice(VERSIONS) for n in names}})))
        files.append((f"p{p}", "/src/a.js", "import x from 'left'" if p % 2 else "import x from 'right'"))
    files = make_files(files)
    context = spark.createDataFrame([], "project string, has_database boolean, is_publicly_deployed boolean, frameworks array<string>")
    plain, staged = (ScanPlan(files, advisories, scanners=("sca",), context=context, stage_as=x)._triaged_counts() for x in (None, "once"))
    tri = ScanPlan(files, advisories, scanners=("sca",), context=context).triaged.withColumn("n", F.lit(1))
    cols = ["project", "severity", "contextual_severity", "auto_ignored", "is_duplicate"]
    want, *got = (sorted(map(str, map(tuple, x.groupBy(*cols).agg(F.sum("n")).collect()))) for x in (tri, plain, staged))
    assert got == [want, want] and len(want) > 20
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "from_json" in plain._jdf.queryExecution().executedPlan().toString() and "from_json" not in plan
