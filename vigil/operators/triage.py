"""Triage: contextual auto-ignore / severity change, dedup, priority.

Scale notes
* Context is one row per project; the join is left to the planner, which
  broadcasts by measured size.
* Dedup counts groups by hash and shuffles, once and by its group, a finding
  whose group may have others. A hot group never meets in one
  task: its primary is an aggregate (``min`` of a struct, partial-aggregated
  map-side), and its findings are dealt into salted parts (see ``dedup_flags``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import confidence_rank, effective_severity, half_up, severity_rank
from ..session import checkpoint_table
from .ranking import numbered

# Fixed values that must equal the reference's for right results.
REASON_TEST_SECRET = "Secret found in test file — likely test fixture or mock value"
REASON_DEV_LOW = "Low severity vulnerability in dev-only dependency without known exploit"
REASON_DEV_UNREACHABLE = "Vulnerability in dev dependency that is not reachable in production"
REASON_FRONTEND_SQL = "SQL injection detected in frontend-only project — may be false positive"
REASON_LOW_CVSS = "Very low CVSS score, no known exploit, and package is not reachable"
FRONTEND_FRAMEWORKS = ["react", "vue", "svelte"]
SERVER_FRAMEWORKS = ["express", "fastify", "koa", "nestjs", "nextjs", "remix"]

SEVERITY_WEIGHT = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0, "info": 5.0}
CONFIDENCE_MULTIPLIER = {"high": 1.0, "medium": 0.85, "low": 0.65}
SCANNER_IMPACT = {"secrets": 100.0, "sast": 80.0, "sca": 60.0, "iac": 50.0, "quality": 30.0}
PRIORITY_WEIGHTS = (0.40, 0.25, 0.20, 0.15)

# CVSS scores below which a dependency finding can be ignored: of any, and of a development dependency.
LOW_CVSS, DEV_CVSS = 3.0, 4.0

CONTEXT_DEFAULTS = {
    "has_database": False, "has_authentication": False, "is_publicly_deployed": False,
    "is_monorepo": False, "has_tests": False,
}


def is_test_file_triage(path: Column) -> Column:
    return (path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)\z") | F.contains(path, F.lit("__tests__"))
            | F.contains(path, F.lit("/test/")) | F.contains(path, F.lit("/tests/"))
            | F.contains(path, F.lit("/spec/")))


def frontend_only(frameworks: Column) -> Column:
    fw = F.coalesce(frameworks, F.array().cast("array<string>"))
    return (F.arrays_overlap(fw, F.array(*map(F.lit, FRONTEND_FRAMEWORKS)))
            & ~F.arrays_overlap(fw, F.array(*map(F.lit, SERVER_FRAMEWORKS))))


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def context_class(cvss: Column, exploit: Column) -> list[Column]:
    """cvss_score, exploit_available as far as ``apply_context`` tells them apart: a score for each side of its bounds, and
    no exploit above them, where it isn't asked for."""
    score = F.when(cvss < LOW_CVSS, 0.0).when(cvss < DEV_CVSS, LOW_CVSS).otherwise(10.0)
    return [score.alias("cvss_score"), (_truthy(exploit) & (cvss < DEV_CVSS)).alias("exploit_available")]


def apply_context(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Add auto_ignored, auto_ignore_reason, contextual_severity.

    The rules are one CASE chain per output column, in source order; an
    ignore rule ends the chain, so an ignored row keeps no contextual
    severity set by a later rule.
    """
    ctx = context.select(
        "project",
        F.col("has_database").alias("_ctx_db"),
        F.col("is_publicly_deployed").alias("_ctx_public"),
        F.col("frameworks").alias("_ctx_fw"))
    j = findings.join(ctx, "project", "left")
    scanner, rule = F.col("scanner"), F.col("rule")
    is_dev, cvss = _truthy(F.col("is_dev_dependency")), F.col("cvss_score")
    exploit, reach = _truthy(F.col("exploit_available")), _truthy(F.col("is_reachable"))
    public, has_db = _truthy(F.col("_ctx_public")), _truthy(F.col("_ctx_db"))

    r1 = (scanner == "secrets") & is_test_file_triage(F.col("path"))
    r2 = (scanner == "sca") & is_dev & _truthy(cvss < DEV_CVSS) & ~exploit
    r3 = (scanner == "sca") & is_dev & ~reach
    r4 = (scanner == "sast") & (rule == "sql-injection-template-literal") & frontend_only(F.col("_ctx_fw"))
    r8 = (scanner == "sca") & _truthy(cvss < LOW_CVSS) & ~exploit & ~reach
    reason = (F.when(r1, REASON_TEST_SECRET).when(r2, REASON_DEV_LOW)
              .when(r3, REASON_DEV_UNREACHABLE).when(r4, REASON_FRONTEND_SQL)
              .when(r8, REASON_LOW_CVSS))
    early_exit = r1 | r2 | r3 | r4
    # later rules overwrite earlier ones, so the last applicable one wins
    r5 = (scanner == "sast") & (rule == "missing-auth-middleware") & ~public
    r6 = (scanner == "sast") & F.contains(rule, F.lit("sql-injection")) & has_db
    r7 = ((scanner == "secrets") | (rule == "hardcoded-credentials")) & public
    sev = F.when(r7, "critical").when(r6, "critical").when(r5, "medium")
    return (j.withColumn("auto_ignored", reason.isNotNull())
            .withColumn("auto_ignore_reason", reason)
            .withColumn("contextual_severity", F.when(~early_exit, sev))
            .drop("_ctx_db", "_ctx_public", "_ctx_fw"))


# ---------------------------------------------------------------------------
# Dedup
# ---------------------------------------------------------------------------

def dedup_key(df: DataFrame | None = None) -> Column:
    """Group key: CVE for dependencies, type + masked value for secrets,
    scanner:path:line:rule otherwise (scoped by project by the callers)."""
    scanner = F.col("scanner")
    undefined = F.lit("undefined")
    return (F.when(scanner == "sca", F.concat(F.lit("sca:cve:"), F.coalesce(F.col("cve"), undefined)))
            .when(scanner == "secrets",
                  F.concat(F.lit("secrets:"), F.coalesce(F.col("secret_type"), undefined), F.lit(":"),
                           F.coalesce(F.col("masked_value"), F.lit("unknown"))))
            .otherwise(F.concat_ws(":", scanner, F.col("path"), F.col("line").cast("string"), F.col("rule"))))


def primary_score(severity: str = "severity", confidence: str = "confidence") -> Column:
    return severity_rank(severity) * 10 + confidence_rank(confidence)


def _order_struct() -> Column:
    # smallest struct = best: highest score first, then a total tie-break
    return F.struct((-primary_score()).alias("neg_score"), F.col("path"), F.col("line"),
                    F.col("column"), F.col("rule"), F.col("id"))


def scan_scope(findings: DataFrame) -> Column:
    """The scan a finding belongs to: its time stamp, or empty for findings of a
    single scan. Findings are duplicates within one scan only."""
    if "scan_ts" not in findings.columns:
        return F.lit("")
    return F.coalesce(F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


# Parts that the findings of a hot group are dealt into by a hash of their id.
SALTS = 64
#: Rows from which on a group counts as hot, and the most groups taken as hot. They decide cost only: any choice of hot
#: groups gives the same flags.
HOT_ROWS, HOT_GROUPS = 100_000, 500
#: 64-bit words of the bit map that tells which groups may have several findings: at most 16 MB, broadcast. It decides cost only:
#: with fewer words, or far more groups, more findings that are alone in their group are shuffled.
SHARED_WORDS = 2 ** 20
GROUP = ["project", "_scan", "group_key"]


def _keyed(findings: DataFrame) -> DataFrame:
    """Findings with their group (project, _scan, group_key) and its hash."""
    scan = F.col("scan_ts") if "scan_ts" in findings.columns else F.lit(None).cast("timestamp")
    keyed = findings.withColumn("group_key", dedup_key()).withColumn("_scan", scan)
    return keyed.withColumn("_hash", F.xxhash64(*GROUP))


def _slot(words: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a bit map."""
    return F.pmod(F.shiftright("_hash", 6), F.lit(words)), F.col("_hash").bitwiseAND(F.lit(63)).cast("int")


def _shared(keyed: DataFrame, hot_rows: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The bit map (word, bits) of the hashes that several findings have, and the hashes of hot groups. Only hashes are shuffled
    for it; both are written, since every part of a plan that reads flags reads them."""
    word, bit = _slot(words)
    sizes = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hot = F.when(F.col("_n") >= hot_rows, F.struct("_n", "_hash"))
    slots = sizes.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"), F.sort_array(F.collect_list(hot), False).alias("hot"))
    stored = checkpoint_table(keyed.sparkSession, slots, "shared-groups")
    hot = stored.select(F.explode("hot").alias("x")).orderBy(F.col("x").desc()).limit(HOT_GROUPS).select(F.col("x._hash").alias("_hash"))
    return stored.select("_word", "_bits"), hot


def _grouped(findings: DataFrame, hot_rows: int, words: int = SHARED_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings with their group: those whose group has no other, and those whose group may have; and the hot groups with their
    primary and size.

    Groups are counted by their hashes. A finding whose hash no other has is alone in its group; all findings of a larger group
    have one hash, so they are among the others, with a few that only share a bit. Of the groups of the largest counts, at most
    ``HOT_GROUPS``, each is then aggregated exactly, which leaves one row for it on the map side."""
    keyed = _keyed(findings)
    shared, top = _shared(keyed, hot_rows, words)
    word, bit = _slot(words)
    marked = keyed.join(F.broadcast(shared), word == F.col("_word"), "left")
    met = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    plain = ("_word", "_bits", "_hash")
    hot = keyed.join(F.broadcast(top), "_hash", "left_semi").groupBy(*GROUP).agg(
        F.min(_order_struct()).alias("best"), F.count(F.lit(1)).alias("_n"))
    hot = hot.select(F.col("project").alias("_hot_project"), F.col("_scan").alias("_hot_scan"),
                     F.col("group_key").alias("_hot_key"), F.col("best.id").alias("_known"), "_n")
    same = (F.col("project").eqNullSafe(F.col("_hot_project")) & F.col("_scan").eqNullSafe(F.col("_hot_scan"))
            & F.col("group_key").eqNullSafe(F.col("_hot_key")))
    j = marked.where(met).drop(*plain).join(F.broadcast(hot), same, "left")
    return marked.where(~met).drop(*plain), j.drop("_hot_project", "_hot_scan", "_hot_key", "_n"), hot


def _order() -> list[Column]:
    return [(-primary_score()).asc(), *map(F.col, ("path", "line", "column", "rule", "id"))]


def _scan_text() -> Column:
    return F.coalesce(F.date_format("_scan", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def dedup_groups(findings: DataFrame, hot_rows: int = HOT_ROWS, words: int = SHARED_WORDS) -> DataFrame:
    """One row per (project, scan, group_key): primary id, related count, total. Findings are shuffled once, those of hot
    groups and those alone in their group not at all."""
    alone, met, hot = _grouped(findings, hot_rows, words)
    w = Window.partitionBy(*GROUP)
    cold = (met.where(F.col("_known").isNull())
            .withColumn("_place", F.row_number().over(w.orderBy(*_order()))).withColumn("_n", F.count(F.lit(1)).over(w))
            .where(F.col("_place") == 1).select(*GROUP, F.col("id").alias("primary_id"), "_n"))
    g = alone.select(*GROUP, F.col("id").alias("primary_id"), F.lit(1).cast("long").alias("_n")).unionByName(cold).unionByName(
        hot.select(F.col("_hot_project").alias("project"), F.col("_hot_scan").alias("_scan"),
                   F.col("_hot_key").alias("group_key"), F.col("_known").alias("primary_id"), "_n"))
    return g.select("project", _scan_text().alias("scan"), "group_key", "primary_id",
                    (F.col("_n") - 1).alias("related_count"), F.col("_n").alias("total_count"))


def dedup_flags(findings: DataFrame, salts: int = SALTS, hot_rows: int = HOT_ROWS, words: int = SHARED_WORDS, stage=lambda df: df) -> DataFrame:
    """Mark ``is_duplicate`` / ``duplicate_of`` on every finding.

    A finding alone in its group is its primary and stays where it is. Others are shuffled once, by their group, and the first in
    order is the primary. The primary of a hot group is known from an aggregation, so its findings are dealt into ``salts`` parts
    by a hash of their id: a group holding a third of all rows meets in no task. ``stage`` writes a table of the shuffled ones,
    for plans that read the flags more than once.
    """
    alone, met, _ = _grouped(findings, hot_rows, words)
    part = F.when(F.col("_known").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0)
    first = F.first("id").over(Window.partitionBy(*GROUP, "_part").orderBy(*_order()))
    j = stage(met.withColumn("_part", part).withColumn("primary_id", F.coalesce("_known", first)).drop("_part", "_known"))
    j = alone.withColumn("primary_id", F.col("id")).unionByName(j)
    dup = F.col("id") != F.col("primary_id")
    return (j.withColumn("is_duplicate", dup)
            .withColumn("duplicate_of", F.when(dup, F.col("primary_id")))
            .drop("primary_id", "_scan"))


def dedup_stats(findings: DataFrame) -> DataFrame:
    """Per project: original count, count after dedup, reduction percent."""
    g = dedup_groups(findings).groupBy("project").agg(
        F.sum("total_count").alias("total_original"), F.count(F.lit(1)).alias("total_after_dedup"))
    pct = F.when(F.col("total_original") > 0,
                 half_up((F.col("total_original") - F.col("total_after_dedup")).cast("double")
                         / F.col("total_original") * 100)).otherwise(0).cast("int")
    return g.withColumn("reduction_percent", pct)


# ---------------------------------------------------------------------------
# Priority
# ---------------------------------------------------------------------------

def _lookup(col: Column, table: dict, default) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def severity_score() -> Column:
    return _lookup(effective_severity(), SEVERITY_WEIGHT, 0.0)


def exploitability_score() -> Column:
    scanner, rule = F.col("scanner"), F.col("rule")
    base = F.col("cvss_score") / 10 * 100
    sca = F.when(_truthy(F.col("exploit_available")), F.least(F.lit(100.0), base * 1.3)).otherwise(base)
    has = lambda s: F.contains(rule, F.lit(s))
    sast = (F.when(has("sql-injection") | has("command-injection"), 90.0).when(has("xss"), 75.0)
            .when(has("path-traversal"), 70.0).when(has("idor"), 65.0).when(has("hardcoded"), 80.0)
            .otherwise(50.0))
    iac = (F.when(has("secret") | has("env"), 85.0).when(has("privileged"), 80.0)
           .when(has("root"), 70.0).otherwise(40.0))
    return (F.when(scanner == "sca", sca).when(scanner == "secrets", 90.0)
            .when(scanner == "sast", sast).when(scanner == "iac", iac).otherwise(50.0))


def reachability_score() -> Column:
    r = F.col("is_reachable")
    return (F.when(r.isNull(), F.when(F.col("scanner") == "sca", 60.0).otherwise(80.0))
            .when(r, 100.0).otherwise(10.0))


def business_impact_score() -> Column:
    base = _lookup(F.col("scanner"), SCANNER_IMPACT, 50.0)
    mult = _lookup(F.col("confidence"), CONFIDENCE_MULTIPLIER, 0.7)
    boosted = F.when((F.col("contextual_severity") == "critical") & (F.col("severity") != "critical"),
                     mult * 1.2).otherwise(mult)
    return F.least(F.lit(100.0), base * boosted)


def prioritize(findings: DataFrame) -> DataFrame:
    """Active findings (not ignored, not duplicate) with priority score and factors."""
    active = findings.where(~_truthy(F.col("auto_ignored")) & ~_truthy(F.col("is_duplicate")))
    s, e, r, b = severity_score(), exploitability_score(), reachability_score(), business_impact_score()
    w = PRIORITY_WEIGHTS
    staged = active.select("*", s.alias("_s"), e.alias("_e"), r.alias("_r"), b.alias("_b"))
    raw = F.col("_s") * w[0] + F.col("_e") * w[1] + F.col("_r") * w[2] + F.col("_b") * w[3]
    score = half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))).cast("int")
    return staged.select(
        *[c for c in active.columns],
        score.alias("priority_score"),
        F.struct(half_up(F.col("_s")).cast("int").alias("severity_score"),
                 half_up(F.col("_e")).cast("int").alias("exploitability_score"),
                 half_up(F.col("_r")).cast("int").alias("reachability_score"),
                 half_up(F.col("_b")).cast("int").alias("business_impact_score")).alias("priority_factors"))


def priority_rank(prioritized: DataFrame) -> DataFrame:
    """``prioritized`` with ``rank``: each finding's place in its project by score, then id."""
    order = [F.col("priority_score").desc(), F.col("id")]
    return numbered(prioritized, ["project"], order).withColumn("rank", F.col("rank").cast("int"))


def triage(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Context rules then dedup flags: the ``triaged_findings`` table
    (all rows, flags set; priority on active rows via ``prioritize``)."""
    return dedup_flags(apply_context(findings, context))
