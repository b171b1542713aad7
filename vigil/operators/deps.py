"""Dependency analysis: manifests -> packages; packages x advisories ->
dependency findings.

The advisory service lookup of the reference becomes a join on *distinct*
(ecosystem, name, version), so it runs once per package version however many
projects use it. Versions and the bounds of affected intervals of a package are
sorted together by their version keys, which makes both plain ranks. An interval
of ranks is cut into the few dyadic blocks that cover it, a version lies in one
block of each level, so the range test is an equi-join on (package, block): no
pair is made that doesn't match, and a package with many versions and advisories
spreads over its blocks. What an advisory says joins its intervals, before versions
multiply them; an advisory's intervals are made disjoint, so nothing is found twice.
Findings then meet projects in one join and are not shuffled afterwards: a finding for
each project, package and advisory is the largest table here. One side of that join is
dealt into ``SPLIT`` parts, the narrower one repeated for each, so a package that a third
of all projects use has no key of its own: counts are repeated and packages dealt by
project, or packages are repeated and findings dealt by advisory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import SEVERITIES, severity_rank
from ..functions.text import js_trim, json_object
from ..functions.versions import version_key
from ..schemas import conform
from ..sources.files import root_file
from .triage import context_class

# Fixed values that must equal the reference's for right results.
SCA_OWASP = "A06:2021 – Vulnerable and Outdated Components"
RULE, MANIFEST_PATH = "vulnerable-dependency", "/package.json"
SCA_DEFAULT_CWE = "CWE-1035"
SCA_DEFAULT_CVSS = 5.0
EXPLOIT_URL_MARKERS = ["exploit", "metasploit", "packetstorm", "exploit-db"]
CVSS_TRAILING = r"(\d+\.\d+)\z"
CVSS_BASE = r"AV:[^/]+/AC:[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/[^/]+:([0-9.]+)"

PACKAGE = ["ecosystem", "name_lc"]
#: A key above those of all versions.
ABOVE = "\U0010ffff"
#: Parts into which the rows of a package are dealt where projects meet its findings.
SPLIT = 8

MANIFEST = T.StructType([
    T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())),
])


def clean_npm_version(spec: Column) -> Column:
    """Strip one leading ^ ~ > = < character, cut at the first space."""
    return F.split(F.regexp_replace(spec, r"^[\^~>=<]", ""), " ").getItem(0)


def npm_packages(files: DataFrame, manifest_path: str = "/package.json") -> DataFrame:
    m = root_file(files, manifest_path).select(
        "project", json_object("content", MANIFEST).alias("m"))
    parts = []
    for col, dev in (("dependencies", False), ("devDependencies", True)):
        e = m.select("project", F.explode(F.col(f"m.{col}")).alias("name", "spec"))
        parts.append(e.select("project", F.lit("npm").alias("ecosystem"), "name",
                              clean_npm_version(F.col("spec")).alias("version"),
                              F.lit(dev).alias("is_dev"), F.lit(True).alias("is_direct")))
    out = parts[0].unionByName(parts[1])
    return out.where((F.length("version") > 0) & (F.col("version") != "*"))


PYPI_LINE = r"^([A-Za-z0-9_\-.]+)[=><~!]+([0-9.]+)"


def pypi_packages(files: DataFrame, manifest_path: str = "/requirements.txt") -> DataFrame:
    f = root_file(files, manifest_path)
    lines = f.select("project", F.explode(F.split("content", "\n", -1)).alias("raw"))
    t = js_trim(F.col("raw"))
    lines = lines.select("project", t.alias("t")).where(
        (F.length("t") > 0) & ~F.col("t").startswith("#") & ~F.col("t").startswith("-")
        & F.col("t").rlike(PYPI_LINE))
    return lines.select("project", F.lit("PyPI").alias("ecosystem"),
                        F.regexp_extract("t", PYPI_LINE, 1).alias("name"),
                        F.regexp_extract("t", PYPI_LINE, 2).alias("version"),
                        F.lit(False).alias("is_dev"), F.lit(True).alias("is_direct"))


def packages_from_manifests(files: DataFrame) -> DataFrame:
    """npm then PyPI packages of each project's root manifests."""
    return npm_packages(files).unionByName(pypi_packages(files))


def dependencies_checked(files: DataFrame) -> DataFrame:
    """Per project: keys of dependencies + devDependencies (npm only, before cleaning)."""
    m = root_file(files, "/package.json").select("project", json_object("content", MANIFEST).alias("m"))
    # size(null) is -1 in legacy mode; guard explicitly
    n = (F.when(F.col("m.dependencies").isNull(), 0).otherwise(F.size("m.dependencies"))
         + F.when(F.col("m.devDependencies").isNull(), 0).otherwise(F.size("m.devDependencies"))).cast("long")
    return m.groupBy("project").agg(F.sum(n).alias("dependencies_checked"))


def affected_intervals(advisories: DataFrame) -> DataFrame:
    """(adv_id, nr, ecosystem, name_lc, lo, hi, closed) of every interval of an advisory's ranges: from an introduced event up to
    the next fixed one after it, or through the next last_affected one (closed). Without an introduced event it is open
    below, without an end open above. Commits are no versions."""
    entry = advisories.select(F.col("id").alias("adv_id"), F.posexplode("affected").alias("e", "a"))
    ranges = F.filter(F.coalesce(F.col("a.ranges"), F.array()), lambda r: ~F.coalesce(r["type"] == "GIT", F.lit(False)))
    entry = entry.select("adv_id", "e", F.col("a.package.ecosystem").alias("ecosystem"), F.lower(F.col("a.package.name")).alias("name_lc"),
                         F.posexplode(F.transform(ranges, lambda r: F.coalesce(r["events"], F.array()))).alias("r", "events"))

    has_last = "last_affected" in entry.schema["events"].dataType.elementType.names
    last = lambda x: x["last_affected"] if has_last else F.lit(None).cast("string")

    def interval(lo: Column, after: Column) -> Column:
        end = F.try_element_at(F.filter(after, lambda x: x["fixed"].isNotNull() | last(x).isNotNull()), F.lit(1))
        return F.struct(lo.alias("lo"), F.coalesce(end["fixed"], last(end)).alias("hi"),
                        (end["fixed"].isNull() & last(end).isNotNull()).alias("closed"))

    events = F.col("events")
    opened = F.filter(F.transform(events, lambda x, i: F.when(x["introduced"].isNotNull(), interval(
        x["introduced"], F.slice(events, i + 2, F.size(events))))), lambda x: x.isNotNull())
    below = F.array(interval(F.lit(None).cast("string"), events))
    out = entry.select("adv_id", "e", "r", "ecosystem", "name_lc",
                       F.posexplode(F.when(F.size(opened) > 0, opened).otherwise(below)).alias("n", "i"))
    key = lambda c: F.when(F.col(c).isNotNull(), version_key(F.col(c), F.col("ecosystem")))
    return out.select("adv_id", F.struct("e", "r", "n").alias("nr"), "ecosystem", "name_lc", key("i.lo").alias("lo"), key("i.hi").alias("hi"), F.col("i.closed").alias("closed"))


def _levels(n: Column) -> Column:
    """Levels 0 up to the first whose one block holds n points and the end."""
    return F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(2))).cast("int"))


def _shifted(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def covering_blocks(lo: Column, hi: Column, n: Column) -> Column:
    """The dyadic blocks (level, block) that make up [lo, hi): of each level the odd one at the left end and the even one
    at the right end, as far as ends are left."""
    def at(level: Column) -> Column:
        a, b = -_shifted(-lo, level), _shifted(hi, level)
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("block")))
        return F.array(left, F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("block"))))

    return F.filter(F.flatten(F.transform(_levels(n), at)), lambda x: x.isNotNull())


def blocks_of(point: Column, n: Column) -> Column:
    return F.transform(_levels(n), lambda level: F.struct(level.alias("level"), _shifted(point, level).alias("block")))


def _ranked(packages: DataFrame, advisories: DataFrame, kept=()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct versions, the same with their rank among the n ranks of their package, and the intervals [a, b) of ranks."""
    versions = packages.select("ecosystem", "name", "version", *kept).distinct().withColumn("name_lc", F.lower("name"))
    versions = versions.withColumn("key", version_key(F.col("version"), F.col("ecosystem")))
    ends = F.array(F.struct(F.lit(False).alias("upper"), F.coalesce("lo", F.lit("")).alias("key")),
                   F.struct(F.lit(True).alias("upper"), F.coalesce("hi", F.lit(ABOVE)).alias("key")))
    bounds = affected_intervals(advisories).select(*PACKAGE, "adv_id", "nr", "closed", F.explode(ends).alias("x")).select(
        *PACKAGE, "adv_id", "nr", "closed", "x.*")
    same_package = Window.partitionBy(*PACKAGE)
    points = versions.unionByName(bounds, allowMissingColumns=True).withColumn(
        "rank", (F.dense_rank().over(same_package.orderBy("key")) - 1).cast("long"))
    points = points.withColumn("n", F.max("rank").over(same_package) + 1)
    intervals = points.where(F.col("adv_id").isNotNull()).groupBy("adv_id", "nr", *PACKAGE, "n").agg(
        F.min(F.when(~F.col("upper"), F.col("rank"))).alias("a"),
        F.min(F.when(F.col("upper"), F.col("rank") + F.col("closed").cast("int"))).alias("b"))
    return versions, points.where(F.col("adv_id").isNull()).select(*PACKAGE, "name", "version", *kept, "rank", "n"), intervals


def _disjoint(intervals: DataFrame) -> DataFrame:
    """Of the intervals of an advisory in a package, what no earlier one holds."""
    before = Window.partitionBy("adv_id", *PACKAGE).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("a", F.greatest("a", F.max("b").over(before))).where(F.col("a") < F.col("b")).select(
        "adv_id", *PACKAGE, "n", "a", "b")


def _listed(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """Versions that an advisory lists by name."""
    listed = advisories.select(F.col("id").alias("adv_id"), F.explode("affected").alias("a")).select(
        "adv_id", F.col("a.package.ecosystem").alias("ecosystem"), F.lower(F.col("a.package.name")).alias("name_lc"),
        F.explode("a.versions").alias("version"))
    return versions.join(listed, [*PACKAGE, "version"])


def _listed_outside(ranked: DataFrame, pieces: DataFrame, advisories: DataFrame, kept=()) -> DataFrame:
    """Versions that an advisory lists by name and that none of its intervals holds."""
    named = _listed(ranked, advisories).select(*PACKAGE, "name", "version", *kept, "rank", "n", "adv_id").distinct()
    # n is the package's own on both sides; asked for here too, the intervals have the same columns in both their uses and are made once
    held = pieces.select(F.col("adv_id").alias("_adv"), F.col("ecosystem").alias("_eco"), F.col("name_lc").alias("_name"), F.col("n").alias("_n"), "a", "b")
    return named.join(held, (F.col("adv_id") == F.col("_adv")) & (F.col("ecosystem") == F.col("_eco")) & (F.col("name_lc") == F.col("_name"))
                      & (F.col("n") == F.col("_n")) & (F.col("a") <= F.col("rank")) & (F.col("rank") < F.col("b")), "left_anti").drop("n")


def sca_match(packages: DataFrame, advisories: DataFrame, facts: DataFrame | None = None, kept=()) -> DataFrame:
    """Distinct (ecosystem, name, version) x advisory ids that affect it: by an interval, or listed by version. With ``facts``
    (by adv_id and name_lc) each row has them too, and what is ``kept`` of the packages (by version)."""
    _, ranked, intervals = _ranked(packages, advisories, kept)
    pieces = _disjoint(intervals)
    out = ["ecosystem", "name", "version", *kept, "adv_id"]
    named = _listed_outside(ranked, pieces, advisories, kept)
    if facts is not None:
        out += [c for c in facts.columns if c not in ("adv_id", "name_lc")]
        pieces, named = (x.join(facts, ["adv_id", "name_lc"]) for x in (pieces, named))
    cover = pieces.drop("a", "b", "n").columns
    cover = pieces.select(*cover, F.explode(covering_blocks(F.col("a"), F.col("b"), F.col("n"))).alias("x"))
    held = ranked.select(*PACKAGE, "name", "version", *kept, F.explode(blocks_of(F.col("rank"), F.col("n"))).alias("x"))
    return held.join(cover, [*PACKAGE, "x"]).select(*out).unionByName(named.select(*out))


def sca_counts(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, severity, n): how many findings of each severity ``sca_findings`` makes of a package version,
    without a row for each. An advisory's intervals in a package, cut to be disjoint, add one at their start and take it
    back at their end; the running sum at a version's rank is its count. Versions listed by name count where no interval
    of the advisory holds them. Rows grow with versions and intervals, not with their pairs."""
    _, ranked, intervals = _ranked(packages, advisories)
    pieces = _disjoint(intervals)
    facts = advisory_facts(advisories).select("adv_id", "name_lc", severity_from_cvss(F.col("cvss")).alias("severity"))
    steps = pieces.drop("n").join(facts, ["adv_id", "name_lc"]).select(*PACKAGE, "severity", F.explode(F.array(
        F.struct(F.col("a").alias("rank"), F.lit(1).alias("step")), F.struct(F.col("b").alias("rank"), F.lit(-1).alias("step")))).alias("x"))
    asked = ranked.select(*PACKAGE, "rank").distinct().withColumn("severity", F.explode(F.array(*map(F.lit, SEVERITIES))))
    steps = steps.select(*PACKAGE, "severity", "x.rank", "x.step").unionByName(asked.withColumn("step", F.lit(0)))
    at = steps.groupBy(*PACKAGE, "severity", "rank").agg(F.sum("step").alias("step")).withColumn(
        "n", F.sum("step").over(Window.partitionBy(*PACKAGE, "severity").orderBy("rank")))
    by_range = ranked.drop("n").join(at.where("n > 0").drop("step"), [*PACKAGE, "rank"]).select("ecosystem", "name", "version", "severity", "n")
    named = _listed_outside(ranked, pieces, advisories)
    by_name = named.join(facts, ["adv_id", "name_lc"]).select("ecosystem", "name", "version", "severity", F.lit(1).alias("n"))
    return by_range.unionByName(by_name).groupBy("ecosystem", "name", "version", "severity").agg(F.sum("n").alias("n"))


def project_counts(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(project, package_name, is_dev_dependency, is_reachable, severity, n): ``sca_findings`` by these columns."""
    own = ["project", F.col("name").alias("package_name"), F.col("is_dev").alias("is_dev_dependency"),
           (~F.col("is_dev")).alias("is_reachable"), "severity"]
    return _meet(packages, sca_counts(packages, advisories)).groupBy(*own).agg(F.sum("n").alias("n"))


def _meet(packages: DataFrame, found: DataFrame) -> DataFrame:
    """What is found of package versions, for every project that has them."""
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    dealt = packages.withColumn("part", F.pmod(F.xxhash64("project"), F.lit(SPLIT)).cast("int"))
    return dealt.join(parts, ["ecosystem", "name", "version", "part"])


def _meet_dealt(packages: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """The same for findings, which are wider and more than the packages: these are repeated, findings dealt ``by`` their own.
    What comes out is far more than what goes in, so tasks are not merged by the size of what they read."""
    key = ["ecosystem", "name", "version", "part"]
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = packages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    dealt = found.withColumn("part", F.pmod(F.xxhash64(by), F.lit(SPLIT)).cast("int"))
    return repeated.repartition(tasks, *key).join(dealt.repartition(tasks, *key), key)


def _with_shared(packages: DataFrame) -> DataFrame:
    """Packages + shared: their name and version is there in several ecosystems."""
    several = packages.groupBy("version", "name").agg((F.min("ecosystem") < F.max("ecosystem")).alias("shared")).where("shared")
    return packages.join(several, ["version", "name"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def cvss_score(adv: Column) -> Column:
    """database score unless 0/null; else first CVSS_V3/V2 vector with a
    trailing d.d or a base-score field; else 5.0."""
    db = F.col("database_specific.cvss_score") if adv is None else adv["database_specific"]["cvss_score"]
    sev = F.col("severity") if adv is None else adv["severity"]
    usable = F.filter(sev, lambda s: s["type"].isin("CVSS_V3", "CVSS_V2")
                      & (s["score"].rlike(CVSS_TRAILING) | s["score"].rlike(CVSS_BASE)))
    first = F.try_element_at(usable, F.lit(1))["score"]
    parsed = F.when(first.rlike(CVSS_TRAILING), F.regexp_extract(first, CVSS_TRAILING, 1)) \
        .otherwise(F.regexp_extract(F.regexp_extract(first, CVSS_BASE, 1), r"^\d*\.?\d*", 0))
    return F.coalesce(F.when(db != 0, db), parsed.try_cast("double"), F.lit(SCA_DEFAULT_CVSS))


def severity_from_cvss(c: Column) -> Column:
    return (F.when(c >= 9.0, "critical").when(c >= 7.0, "high").when(c >= 4.0, "medium")
            .when(c >= 0.1, "low").otherwise("info"))


def _matching_affected(name: Column) -> Column:
    return F.filter(F.coalesce(F.col("affected"), F.array()), lambda a: F.lower(a["package"]["name"]) == F.lower(name))


def fixed_version(name: Column) -> Column:
    fixes = F.flatten(F.transform(_matching_affected(name), lambda a: F.flatten(F.transform(
        F.coalesce(a["ranges"], F.array()), lambda r: F.transform(
            F.filter(r["events"], lambda e: F.length(e["fixed"]) > 0), lambda e: e["fixed"])))))
    return F.try_element_at(fixes, F.lit(1))


def vulnerable_range(name: Column) -> Column:
    def range_text(r):
        intro = F.try_element_at(F.filter(r["events"], lambda e: F.length(e["introduced"]) > 0), F.lit(-1))["introduced"]
        fixed = F.try_element_at(F.filter(r["events"], lambda e: F.length(e["fixed"]) > 0), F.lit(-1))["fixed"]
        return (F.when(intro.isNotNull() & fixed.isNotNull(), F.concat(F.lit(">= "), intro, F.lit(", < "), fixed))
                .when(intro.isNotNull(), F.concat(F.lit(">= "), intro))
                .when(fixed.isNotNull(), F.concat(F.lit("< "), fixed)))
    per_aff = F.transform(_matching_affected(name), lambda a: F.array_join(
        F.filter(F.transform(F.coalesce(a["ranges"], F.array()), range_text), lambda x: x.isNotNull()), " || "))
    first = F.try_element_at(F.filter(per_aff, lambda s: F.length(s) > 0), F.lit(1))
    return F.coalesce(first, F.lit("< *"))


def has_exploit() -> Column:
    refs = F.coalesce(F.col("references"), F.array())
    return F.exists(refs, lambda r: (r["type"] == "EVIDENCE") | F.contains(r["url"], F.lit("exploit"))
                    | F.contains(r["url"], F.lit("metasploit")) | F.contains(r["url"], F.lit("packetstorm"))
                    | F.contains(r["url"], F.lit("exploit-db")))


def cve_of() -> Column:
    cves = F.filter(F.coalesce(F.col("aliases"), F.array()), lambda a: a.startswith("CVE-"))
    return F.coalesce(F.try_element_at(cves, F.lit(1)), F.col("id"))


def advisory_facts(advisories: DataFrame, *more: Column) -> DataFrame:
    """Per (advisory, lower-cased affected name): every value a finding takes
    from the advisory, computed once per advisory entry rather than once per
    project finding (and ``more`` of it)."""
    names = advisories.select("*", F.explode(F.array_distinct(F.transform(
        F.coalesce(F.col("affected"), F.array()), lambda a: F.lower(a["package"]["name"])))).alias("name_lc"))
    name = F.col("name_lc")
    return names.select(
        F.col("id").alias("adv_id"), "name_lc", "summary", "details",
        cvss_score(None).alias("cvss"), fixed_version(name).alias("fixed"), vulnerable_range(name).alias("rng"),
        F.coalesce(F.try_element_at(F.col("database_specific.cwe_ids"), F.lit(1)), F.lit(SCA_DEFAULT_CWE)).alias("cwe"),
        cve_of().alias("cve"), has_exploit().alias("exploit"), *more)


def _by_cve(advisories: DataFrame) -> DataFrame:
    """Advisories of a CVE as one, with the packages of them all."""
    known = advisories.where(F.col("id").isNotNull()).select(cve_of().alias("id"), "affected")
    return known.groupBy("id").agg(F.flatten(F.collect_list("affected")).alias("affected"))


def sca_cves(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Distinct (project, package_name, installed_version, cve) of ``sca_findings``. The advisories of a CVE are matched as one, so
    a package version has a CVE once, and these are shuffled once, to where they meet projects. Only a name and version that is
    there in several ecosystems can have a CVE twice: a project that has it has one row with all of these, its CVE one with all
    that it is known in."""
    packages = _with_shared(packages)
    found = sca_match(packages, _by_cve(advisories), kept=["shared"]).withColumnRenamed("adv_id", "cve")
    own = packages.where("NOT shared").select("project", "ecosystem", "name", "version").distinct()
    plain = _meet_dealt(own, found.where("NOT shared").drop("shared"), "cve")

    key = ["name", "version", "part"]
    met = found.where("shared").withColumn("part", F.pmod(F.xxhash64("cve"), F.lit(SPLIT)).cast("int")).repartition(*key).groupBy(
        *key, "cve").agg(F.collect_set("ecosystem").alias("known_in"))
    repeated = packages.where("shared").groupBy("project", "name", "version").agg(
        F.collect_set("ecosystem").alias("ecosystems")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    several = repeated.join(met, key).where(F.arrays_overlap("ecosystems", "known_in"))
    return plain.select("project", "name", "version", "cve").unionByName(several.select("project", "name", "version", "cve")).select(
        "project", F.col("name").alias("package_name"), F.col("version").alias("installed_version"), "cve")


def sca_findings(packages: DataFrame, advisories: DataFrame, conform_schema: bool = True) -> DataFrame:
    """A finding for each package of a project and advisory that affects it. Where packages say whether they are reachable
    (``reach.package_reachability``), their findings say the same."""
    j = _meet_dealt(packages, sca_match(packages, advisories, advisory_facts(advisories)), "adv_id")
    out = _as_findings(j, [c for c in ("is_reachable", "reachability_reason") if c in packages.columns])
    return conform(out) if conform_schema else out


def _message(title: Column) -> Column:
    return F.concat("name", F.lit("@"), "version", F.lit(" has known vulnerability: "), title)


def _fix_suggestion() -> Column:
    name = F.col("name")
    return (F.when(F.length("fixed") > 0, F.concat(F.lit("Upgrade "), name, F.lit(" to version "), F.col("fixed"), F.lit(" or later")))
            .otherwise(F.concat(F.lit("No fix available yet. Consider replacing "), name, F.lit(" or adding mitigations"))))


def _title() -> Column:
    return F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("adv_id"))


def _as_findings(met: DataFrame, known=()) -> DataFrame:
    """Packages of projects that have met what is found of their versions, as findings."""
    name, ver = F.col("name"), F.col("version")
    return met.select(
        F.sha2(F.concat_ws("|", F.lit("sca"), "project", F.lit(MANIFEST_PATH), F.lit("1"),
                           F.lit(RULE), "cve", "name", "version", "adv_id"), 256).alias("id"),
        "project", F.lit("sca").alias("scanner"), F.lit(RULE).alias("rule"),
        severity_from_cvss(F.col("cvss")).alias("severity"), F.lit("high").alias("confidence"),
        F.lit(MANIFEST_PATH).alias("path"), F.lit(1).alias("line"),
        _message(_title()).alias("message"),
        "cwe", F.lit(SCA_OWASP).alias("owasp"), _fix_suggestion().alias("fix_suggestion"),
        name.alias("package_name"), ver.alias("installed_version"), F.col("rng").alias("vulnerable_range"),
        F.col("fixed").alias("fixed_version"), "cve", F.col("cvss").alias("cvss_score"),
        F.coalesce(F.nullif(F.col("details"), F.lit("")), F.nullif(F.col("summary"), F.lit("")),
                   F.concat(F.lit("Vulnerability in "), name)).alias("description"),
        F.col("is_dev").alias("is_dev_dependency"), F.col("is_direct").alias("is_direct"),
        *(known or [(~F.col("is_dev")).alias("is_reachable")]), F.col("exploit").alias("exploit_available"))


def cve_groups(advisories: DataFrame) -> DataFrame:
    """(cve, single, open) of every CVE that advisories have: ``single`` if it has one advisory, of one package. Not ``open`` is
    one whose advisories are all of one package and, where they have the same severity, are the same to the context rules:
    which finding of a package version is the primary then needs no look at the findings themselves."""
    families = F.array_distinct(F.transform(F.coalesce("affected", F.array()), lambda a: F.struct(
        a["package"]["ecosystem"].alias("ecosystem"), F.lower(a["package"]["name"]).alias("name_lc"))))
    one = advisories.select("id", cve_of().alias("cve"), severity_from_cvss(cvss_score(None)).alias("severity"),
                            F.struct(*context_class(cvss_score(None), has_exploit())).alias("kind"), F.explode(families).alias("family"))
    rows, distinct = F.count(F.lit(1)), lambda *c: F.count_distinct(F.struct(*c))
    open_ = (distinct("family") > 1) | (distinct("id") < rows) | (distinct("severity", "kind") > distinct("severity"))
    return one.groupBy("cve").agg((rows == 1).alias("single"), open_.alias("open"))


def _families(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, name_lc) of the packages that an advisory names."""
    return advisories.select("id", F.explode("affected").alias("a")).select(
        "id", F.col("a.package.ecosystem").alias("ecosystem"), F.lower(F.col("a.package.name")).alias("name_lc"))


def sca_decided(packages: DataFrame, advisories: DataFrame, stage=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """``sca_findings`` in two parts that no duplicates link, for packages with ``is_reachable``. First, counts: (project,
    what ``triage.apply_context`` reads, is_duplicate, n) of packages that are their project's only row of this name and of
    CVEs that are not ``open``: such a finding has no duplicates but those of its own package version and CVE, and the one
    of the highest severity is the primary, so they are counted by package version before projects multiply them.
    Second, the findings of all other packages and CVEs, a row each. ``stage`` writes a table: packages and advisories are read
    many times, and the second part, mostly small, asks for the packages and advisories that can meet there only."""
    groups = cve_groups(advisories).withColumnRenamed("cve", "_cve")
    marked = stage(advisories.withColumn("_cve", cve_of()).join(groups, "_cve").drop("_cve"), "advisories")
    open_, closed = marked.where("open").drop("single", "open"), marked.where("NOT open").drop("open")
    family = Window.partitionBy("project", "ecosystem", F.lower("name"))
    counted = stage(packages.withColumn("_rows", F.count(F.lit(1)).over(family)), "packages")
    alone, crowded = counted.where("_rows = 1").drop("_rows"), counted.where("_rows > 1").drop("_rows")

    lower = F.lower("name").alias("name_lc")
    affected = stage(counted.select(*packages.columns, lower).join(
        _families(open_).select(*PACKAGE).distinct(), PACKAGE, "left_semi").select(*packages.columns), "open-packages")
    naming = _families(closed).join(crowded.select("ecosystem", lower).distinct(), PACKAGE, "left_semi").select("id").distinct()
    naming = stage(closed.drop("single").join(naming, "id", "left_semi"), "crowded-advisories")
    rows = sca_findings(affected, open_).unionByName(sca_findings(crowded, naming))

    facts = advisory_facts(closed, F.col("single")).select(
        "adv_id", "name_lc", "cve", "single", severity_from_cvss(F.col("cvss")).alias("severity"), *context_class(F.col("cvss"), F.col("exploit")))
    match = sca_match(alone, closed, facts)
    version = ["ecosystem", "name", "version"]
    place = F.row_number().over(Window.partitionBy(*version, "cve").orderBy(severity_rank("severity").desc()))
    match = match.where("single").withColumn("is_duplicate", F.lit(False)).unionByName(
        match.where(~F.col("single")).withColumn("is_duplicate", place > 1))
    kind = ["severity", "cvss_score", "exploit_available", "is_duplicate"]
    counts = _meet(alone, match.groupBy(*version, *kind).agg(F.count(F.lit(1)).alias("n"))).select(
        "project", F.lit("sca").alias("scanner"), F.lit(RULE).alias("rule"), F.lit(MANIFEST_PATH).alias("path"),
        F.col("is_dev").alias("is_dev_dependency"), "is_reachable", *kind, "n")
    return counts, rows


def _by_answer(advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advisories that say the same of a package (CVE, score, title, fixed version) as one under the least id, with their
    packages; and what they say, by adv_id and name_lc."""
    said = ["name_lc", "cve", "cvss", "title", "fixed"]
    facts = advisory_facts(advisories.where(F.col("id").isNotNull()), _matching_affected(F.col("name_lc")).alias("affected"))
    facts = facts.withColumn("title", _title()).withColumn("fixed", F.nullif("fixed", F.lit("")))
    one = facts.groupBy(*said).agg(F.min("adv_id").alias("adv_id"), F.flatten(F.collect_list("affected")).alias("affected"))
    return one.select(F.col("adv_id").alias("id"), "affected"), one.select("adv_id", *said)


def package_answers(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """What ``sca_findings`` says of package versions, whatever the project, each distinct row once. Advisories that say the same
    of a package are matched as one, so only a name and version that is there in several ecosystems can have an answer twice;
    answers of all others are not shuffled once they are made."""
    one, facts = _by_answer(advisories)
    found = sca_match(_with_shared(packages.select("ecosystem", "name", "version").distinct()), one, facts, kept=["shared"]).drop("ecosystem")
    found = found.where("NOT shared").unionByName(found.where("shared").distinct())
    return found.select(F.col("name").alias("package_name"), F.col("version").alias("installed_version"), "cve",
                        severity_from_cvss(F.col("cvss")).alias("severity"), F.col("cvss").alias("cvss_score"),
                        _message(F.col("title")).alias("message"), _fix_suggestion().alias("fix_suggestion"))


def check_package(advisories: DataFrame, packages: DataFrame, answers: bool = False) -> DataFrame:
    """Look up given (ecosystem, name, version) rows (one package or many): a finding for each advisory, or the distinct
    ``package_answers`` only."""
    if answers:
        return package_answers(packages, advisories)
    pk = packages.select("ecosystem", "name", "version",
                         F.lit("lookup").alias("project"), F.lit(False).alias("is_dev"), F.lit(True).alias("is_direct"))
    return sca_findings(pk, advisories)
