"""Reports: ordering, top-n, trend, status between scans, sinks.

Top-n per project uses ``row_number() <= n`` over a project window; Spark
plans it with a *partial* WindowGroupLimit before the shuffle, so each map
task ships at most n rows per project: a project holding a third of all
rows never lands whole in one task. Reports are written as ordered line
rows (``write.text`` partitioned by project), never assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.severity import effective_severity, grade, severity_rank
from ..functions.text import file_tail2, truncate_ellipsis
from ..session import scratch_path
from .metrics import is_active

# Fixed values that must equal the reference's for right results.
SEVERITY_EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
CWE_RESOURCES = {
    "CWE-89": ["https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html",
               "https://owasp.org/www-community/attacks/SQL_Injection"],
    "CWE-79": ["https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html"],
    "CWE-78": ["https://cheatsheetseries.owasp.org/cheatsheets/OS_Command_Injection_Defense_Cheat_Sheet.html"],
    "CWE-22": ["https://cheatsheetseries.owasp.org/cheatsheets/File_Upload_Cheat_Sheet.html"],
    "CWE-798": ["https://cheatsheetseries.owasp.org/cheatsheets/Secrets_Management_Cheat_Sheet.html"],
    "CWE-639": ["https://cheatsheetseries.owasp.org/cheatsheets/Insecure_Direct_Object_Reference_Prevention_Cheat_Sheet.html"],
}
TOP_CONSOLE, TOP_CLI, TOP_TOOL, TOP_DASH, TOP_DETAILS = 50, 20, 10, 6, 20


def severity_order() -> list[Column]:
    """Effective severity descending, then a total tie-break."""
    return [severity_rank(effective_severity()).desc(), F.col("path").asc_nulls_first(),
            F.col("line").asc_nulls_first(), F.col("rule").asc_nulls_first(), F.col("id").asc_nulls_first()]


def sort_by_severity(triaged: DataFrame) -> DataFrame:
    return triaged.where(is_active()).orderBy(*severity_order())


def top_n(triaged: DataFrame, n: int, order: list[Column] | None = None, keys=("project",)) -> DataFrame:
    """First n active findings per project in the given order (+ rank)."""
    w = Window.partitionBy(*keys).orderBy(*(order or severity_order()))
    return (triaged.where(is_active()).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def more_count(triaged: DataFrame, n: int) -> DataFrame:
    """'... and k more findings' count per project."""
    return (triaged.where(is_active()).groupBy("project").agg(F.count(F.lit(1)).alias("total"))
            .withColumn("more", F.greatest(F.col("total") - n, F.lit(0))))


def console_rows(top: DataFrame) -> DataFrame:
    """Console table cells: severity, scanner, truncated rule and file tail."""
    return top.select("project", "rank", F.upper(effective_severity()).alias("sev"),
                      F.upper("scanner").alias("scanner"), truncate_ellipsis(F.col("rule"), 28).alias("rule"),
                      truncate_ellipsis(file_tail2(F.col("path")), 33).alias("file"), "line")


def trend(triaged: DataFrame) -> DataFrame:
    """Per project and scan (its time stamp): active counts, score and its direction."""
    from .metrics import severity_count_aggs, with_score
    s = with_score(triaged.groupBy("project", "scan_ts").agg(*severity_count_aggs()))
    w = Window.partitionBy("project").orderBy("scan_ts")
    prev = F.lag("security_score").over(w)
    return s.select("project", "scan_ts", "critical", "high", "medium", "security_score",
                    prev.alias("previous_score"),
                    F.when(prev.isNull(), "new").when(F.col("security_score") > prev, "improving")
                    .when(F.col("security_score") < prev, "declining").otherwise("stable").alias("direction"))


def fingerprint() -> Column:
    """Identity of a finding across scans (ids are per scan), in hex. Dependency findings of a
    project share rule, path and line; CVE, package and version tell them apart."""
    own = [F.coalesce(c, F.lit("")) for c in ("cve", "package_name", "installed_version")]
    return F.sha2(F.concat_ws("|", "scanner", "rule", "path", F.col("line").cast("string"), *own), 256)


#: Rows from which on a project is dealt into parts where its findings meet, how many parts, and the most projects dealt. They
#: decide cost only.
HOT_PROJECT, PARTS, HOT_PROJECTS = 1_000_000, 64, 500


def presence(triaged: DataFrame, hot_rows: int = HOT_PROJECT, parts: int = PARTS) -> DataFrame:
    """(project, part, fp, scan_no, last_no, sev_rank, ignored): the scans in which a finding was seen, a project's scans numbered
    by their time stamps; ignored where all its rows were auto-ignored or duplicates. ``before`` and ``after``: the scans in
    which it was seen next. Rows are shuffled once, by project and part, and all that follows for a finding keeps to that: a
    project has one part, a hot one (a frequent-items sketch names them) ``parts`` by a hash of the finding, each with the
    stamps of all its scans. ``fp`` is binary here, half as long."""
    rows = triaged.select("project", "scan_ts", F.unhex(fingerprint()).alias("fp"),
                          severity_rank(effective_severity()).alias("sev_rank"), (~is_active()).cast("int").alias("ignored"))
    own = F.xxhash64("project")
    top = rows.agg(F.expr(f"approx_top_k(xxhash64(project), {HOT_PROJECTS}, {4 * HOT_PROJECTS})").alias("top"))
    top = F.broadcast(top.select(F.explode("top").alias("x")).where(F.col("x.count") >= hot_rows).select(F.col("x.item").alias("_hot")))
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int")).otherwise(0)
    dealt = rows.join(top, own == F.col("_hot"), "left").withColumn("part", part).drop("_hot")
    stamps = rows.select("project", "scan_ts").join(top, own == F.col("_hot"), "left_semi").distinct().withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    w = Window.partitionBy("project", "part")
    seen = dealt.unionByName(stamps, allowMissingColumns=True).withColumn("scan_no", F.dense_rank().over(w.orderBy("scan_ts"))).withColumn(
        "last_no", F.max("scan_no").over(w)).where("fp IS NOT NULL AND scan_ts IS NOT NULL AND project IS NOT NULL")
    seen = seen.groupBy("project", "part", "fp", "scan_no", "last_no").agg(
        F.max("sev_rank").alias("sev_rank"), F.min("ignored").cast("boolean").alias("ignored"))
    w = Window.partitionBy("project", "part", "fp").orderBy("scan_no")
    return seen.withColumn("before", F.lag("scan_no").over(w)).withColumn("after", F.lead("scan_no").over(w))


def _hex(fp: str = "fp") -> Column:
    return F.lower(F.hex(fp)).alias("fp")


def status_diff(triaged: DataFrame) -> DataFrame:
    """Per project, scan from the second on, and finding: new, reopened (seen before, not in the scan before), open, ignored,
    or fixed (seen in the scan before only)."""
    p = presence(triaged)
    status = (F.when(F.col("ignored"), "ignored").when(F.col("before").isNull(), "new")
              .when(F.col("before") < F.col("scan_no") - 1, "reopened").otherwise("open"))
    gone = (F.col("scan_no") < F.col("last_no")) & (F.coalesce("after", F.col("last_no") + 1) > F.col("scan_no") + 1)
    here = F.when(F.col("scan_no") > 1, F.struct("scan_no", status.alias("status")))
    fixed = F.when(gone, F.struct((F.col("scan_no") + 1).alias("scan_no"), F.lit("fixed").alias("status")))
    both = F.filter(F.array(here, fixed), lambda x: x.isNotNull())
    return p.select("project", "fp", "sev_rank", F.explode(both).alias("x")).select("project", "x.scan_no", _hex(), "x.status", "sev_rank")


def _runs(triaged: DataFrame) -> DataFrame:
    begins = F.coalesce(F.col("before") < F.col("scan_no") - 1, F.lit(True)).cast("int")
    nr = F.sum(begins).over(Window.partitionBy("project", "part", "fp").orderBy("scan_no"))
    return presence(triaged).withColumn("island", nr).groupBy("project", "part", "fp", "last_no", "island").agg(
        F.min("scan_no").alias("first_scan"), F.max("scan_no").alias("last_scan"),
        F.max_by("ignored", "scan_no").alias("ignored"), F.max_by("sev_rank", "scan_no").alias("sev_rank"))


def islands(triaged: DataFrame) -> DataFrame:
    """(project, fp, first_scan, last_scan, ignored, sev_rank): each run of consecutive scans in which a finding was seen, with
    its state in the last of them."""
    return _runs(triaged).select("project", _hex(), "island", "first_scan", "last_scan", "ignored", "sev_rank")


def life_cycle(triaged: DataFrame) -> DataFrame:
    """One row for each finding of a project over all its scans: first and last scan, how often it came back, and its status:
    fixed if the last scan no longer has it, else ignored or open."""
    own = _runs(triaged).groupBy("project", "part", "fp", "last_no").agg(
        F.min("first_scan").alias("first_scan"), F.max("last_scan").alias("last_scan"),
        (F.count(F.lit(1)) - 1).alias("reopened"), F.max_by("ignored", "last_scan").alias("ignored"),
        F.max_by("sev_rank", "last_scan").alias("sev_rank"))
    status = F.when(F.col("last_scan") < F.col("last_no"), "fixed").when(F.col("ignored"), "ignored").otherwise("open")
    return own.select("project", _hex(), status.alias("status"), "first_scan", "last_scan", "reopened", "sev_rank")


def markdown_lines(triaged: DataFrame, scores: DataFrame) -> DataFrame:
    """Report rows from triaged findings and their ``metrics.report_scores``: part 0 header,
    1 findings table (all active findings), 2 details (heading, first 20), with their sort keys (severity rank, path, line,
    rule, id); ``write_markdown`` writes them in order per project. No
    per-project window over all findings: the table part is ordered by a
    global sort, the details by a bounded top-n."""
    eff = effective_severity()
    emoji = F.element_at(F.create_map(*[x for k, v in SEVERITY_EMOJI.items() for x in (F.lit(k), F.lit(v))]), eff)
    header = scores.select(
        "project", F.lit(0).alias("part"), F.lit(0).alias("rank"),
        F.concat_ws("\n", F.lit("# Security Scan Report"), F.lit(""),
                    F.concat(F.lit("**Project:** "), F.col("project"), F.lit("  ")), F.lit(""),
                    F.lit("## Security Score"), F.lit(""),
                    F.concat(F.lit("### "), F.col("security_score").cast("string"), F.lit("/100 — Grade "), F.col("grade")),
                    F.lit(""), F.lit("## Summary"), F.lit(""), F.lit("| Severity | Count |"), F.lit("|----------|-------|"),
                    F.concat(F.lit("| 🔴 Critical | "), F.col("critical").cast("string"), F.lit(" |")),
                    F.concat(F.lit("| 🟠 High | "), F.col("high").cast("string"), F.lit(" |")),
                    F.concat(F.lit("| 🟡 Medium | "), F.col("medium").cast("string"), F.lit(" |")),
                    F.concat(F.lit("| 🔵 Low | "), F.col("low").cast("string"), F.lit(" |")),
                    F.concat(F.lit("| ⚪ Info | "), F.col("info").cast("string"), F.lit(" |")),
                    F.concat(F.lit("| **Total** | **"), F.col("total").cast("string"), F.lit("** |")),
                    F.lit(""),
                    F.concat(F.lit("> "), F.col("noise_reduction_percent").cast("string"), F.lit("% noise reduction applied — "),
                             F.col("auto_ignored").cast("string"), F.lit(" findings auto-suppressed")),
                    F.lit(""), F.lit("## Findings"), F.lit(""),
                    F.lit("| Severity | Scanner | Rule | File | Line | Message |"),
                    F.lit("|----------|---------|------|------|------|---------|")).alias("text"))
    active = triaged.where(is_active())
    keys = [severity_rank(eff).alias("sev_rank"), "path", "line", "rule", "id"]
    table = active.select("project", F.lit(1).alias("part"), *keys, F.concat(
        F.lit("| "), emoji, F.lit(" "), eff, F.lit(" | "), F.col("scanner"), F.lit(" | `"), F.col("rule"),
        F.lit("` | `"), file_tail2(F.col("path")), F.lit("` | "), F.col("line").cast("string"), F.lit(" | "),
        F.col("message"), F.lit(" |")).alias("text"))
    details = top_n(triaged, TOP_DETAILS).select("project", F.lit(2).alias("part"), *keys, F.concat_ws(
        "\n", F.concat(F.lit("### "), F.col("rule")), F.lit(""),
        F.concat(F.lit("**Severity:** "), eff, F.lit("  ")),
        F.concat(F.lit("**File:** `"), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("`  ")),
        F.concat(F.lit("**CWE:** "), F.coalesce(F.nullif(F.col("cwe"), F.lit("")), F.lit("N/A")), F.lit("  ")),
        F.lit(""), F.col("message"), F.lit(""),
        F.when(F.length("snippet") > 0, F.concat_ws("\n", F.lit("```"), F.col("snippet"), F.lit("```"), F.lit(""))),
        F.when(F.length("fix_suggestion") > 0, F.concat(F.lit("**Fix:** "), F.col("fix_suggestion"), F.lit("\n"))),
        F.lit("---"), F.lit("")).alias("text"))
    # without keys: before the findings of its part
    heading = scores.select("project", F.lit(2).alias("part"), F.lit("\n## Details\n").alias("text"))
    header = header.select("project", "part", "text").unionByName(heading).select(
        "project", "part", F.lit(None).cast("int").alias("sev_rank"),
                           F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"),
                           F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("id"), "text")
    return header.unionByName(table).unionByName(details)


def markdown_order() -> list:
    return ["project", "part", F.col("sev_rank").desc_nulls_first(), F.col("path").asc_nulls_first(),
            F.col("line").asc_nulls_first(), F.col("rule").asc_nulls_first(), F.col("id").asc_nulls_first()]


def write_markdown(lines: DataFrame, out_dir: str) -> None:
    """Global sort (range partitioning splits a hot project over many tasks);
    each project's part files, read in name order, are the report in order."""
    (lines.orderBy(*markdown_order()).select("project", "text")
     .write.mode("overwrite").partitionBy("project").text(out_dir))


#: What the JSON output says of a finding.
JSON_FINDING = ["id", "scanner", "rule", "severity", "confidence", "path", "line", "message", "cwe", "owasp", "snippet",
                "fix_suggestion", "contextual_severity", "auto_ignored", "auto_ignore_reason", "is_duplicate", "duplicate_of"]


def json_lines(triaged: DataFrame, summary: DataFrame) -> DataFrame:
    """The whole result as JSON lines: a summary per project and a line per finding, ignored ones and
    duplicates too (no document per project: a project may hold a third of all findings)."""
    keep = {"ignoreNullFields": "false"}
    total = summary.select("project", F.lit("summary").alias("kind"),
                           F.to_json(F.struct(*[F.col(c) for c in summary.columns]), keep).alias("json"))
    return total.unionByName(triaged.select("project", F.lit("finding").alias("kind"),
                                            F.to_json(F.struct(*JSON_FINDING), keep).alias("json")))


#: Buckets of stored findings, by id.
BUCKETS = 64


def store_findings(findings: DataFrame, name: str, buckets: int = BUCKETS) -> str:
    """Write findings as a table for lookups, and return its name in the catalogue: bucketed and sorted by id, one file a
    bucket, with Parquet bloom filters on id. Its files lie in a folder of their own under the shared checkpoint folder."""
    spark = findings.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    (findings.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path)
     .option("parquet.bloom.filter.enabled#id", "true").saveAsTable(table))
    return table


def lookup(spark: SparkSession, table: str, ids) -> DataFrame:
    """Stored findings with the ids: given as a list, only the buckets that can hold them are read; given as a frame with a
    column ``id``, the stored side of the join is not shuffled."""
    stored = spark.table(table)
    if isinstance(ids, DataFrame):
        return stored.join(ids.select("id").distinct(), "id", "left_semi")
    return stored.where(F.col("id").isin(list(ids)))


def write_csv(findings: DataFrame, out_dir: str) -> None:
    cols = ["id", "project", "scanner", "rule", "severity", "confidence", "path", "line", "message", "cwe"]
    findings.select(*cols).write.mode("overwrite").option("header", True).csv(out_dir)


def cwe_resources(spark) -> DataFrame:
    """Fixed lookup table (bounded: six rows) of per-CWE reading links."""
    rows = [(k, u) for k, v in CWE_RESOURCES.items() for u in v]
    return spark.createDataFrame(rows, "cwe string, url string")


def finding_lookup(findings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Findings (with ``ids``: those) with their CWE resource links (left join to
    the fixed six-row table, broadcast: bounded by construction)."""
    spark = findings.sparkSession
    res = cwe_resources(spark).groupBy("cwe").agg(F.sort_array(F.collect_list("url")).alias("resources"))
    hit = findings if ids is None else findings.join(ids, "id", "left_semi")
    return hit.join(F.broadcast(res), "cwe", "left").withColumn(
        "resources", F.coalesce(F.col("resources"), F.array().cast("array<string>")))


def grade_of(score: Column) -> Column:
    return grade(score)
