"""Queries of sections 2.1-2.7: sources, line operators, secrets, code,
configuration, dependencies and reachability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.entropy import is_placeholder, mask_value, shannon_entropy
from ..operators import code as C
from ..operators import config as G
from ..operators import deps as D
from ..operators import lines as L
from ..operators import reach as R
from ..operators import secrets as S
from ..sources import files as FS
from . import oracle as O
from . import oracle_detect  # noqa: F401  (registers the detection CTEs)
from .q_core import corpus_of
from .queries import query

ORACLE: dict = {}


def oracle(key, select, needed):
    ORACLE[key] = lambda: O.with_ctes(select, needed)


def files_of(spark, sf_dir):
    return corpus_of(spark, sf_dir).files


# ---------------------------------------------------------------------------
# 2.1 sources
# ---------------------------------------------------------------------------

@query("src_code_files", "2.1")
def _(spark, sf):
    return FS.code_files(files_of(spark, sf)).select("project", "path")


oracle("src_code_files", "SELECT project, path FROM code_src", ["code_src"])


@query("src_secret_files", "2.1")
def _(spark, sf):
    return FS.without_binary(FS.secret_files(files_of(spark, sf))).select("project", "path")


oracle("src_secret_files", "SELECT project, path FROM secret_src", ["secret_src"])


@query("src_config_files", "2.1")
def _(spark, sf):
    return FS.config_files(files_of(spark, sf)).select("project", "path", "kind")


oracle("src_config_files", "SELECT project, path, kind FROM cfg", ["cfg"])


@query("src_import_files", "2.1")
def _(spark, sf):
    return FS.import_files(files_of(spark, sf)).select("project", "path")


oracle("src_import_files", "SELECT project, path FROM imp_src", ["imp_src"])


@query("src_binary_skip", "2.1")
def _(spark, sf):
    f = files_of(spark, sf)
    return f.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.contains(F.col("content"), F.lit("\u0000"))).alias("n_text_files"))


oracle("src_binary_skip", "SELECT project, count(*) AS n_files, count(*) FILTER (WHERE NOT contains(content, chr(0))) AS n_text_files "
       "FROM files GROUP BY project", ["files"])


@query("src_manifest_npm", "2.1")
def _(spark, sf):
    return D.npm_packages(files_of(spark, sf))


oracle("src_manifest_npm", "SELECT * FROM npm_packages", ["npm_packages"])


@query("src_manifest_pypi", "2.1")
def _(spark, sf):
    return D.pypi_packages(files_of(spark, sf))


oracle("src_manifest_pypi", "SELECT * FROM pypi_packages", ["pypi_packages"])


@query("src_advisories", "2.1")
def _(spark, sf):
    a = corpus_of(spark, sf).advisories
    e = a.select("id", "summary", "aliases", "database_specific", F.explode("affected").alias("aff"))
    return e.select("id", F.col("aff.package.name").alias("package_name"),
                    F.col("aff.package.ecosystem").alias("ecosystem"),
                    F.size("aliases").alias("n_aliases"), F.col("database_specific.cvss_score").alias("db_cvss"),
                    F.aggregate(F.coalesce(F.col("aff.ranges"), F.array()), F.lit(0),
                                lambda n, r: n + F.coalesce(F.size(r["events"]), F.lit(0))).alias("n_events"), "summary")


oracle("src_advisories",
       "SELECT id, pkg_name AS package_name, pkg_ecosystem AS ecosystem, CAST(cve_alias IS NOT NULL AS INTEGER) AS n_aliases, "
       "db_cvss, " + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("introduced", "fixed", "last_affected", "introduced2", "fixed2"))
       + " AS n_events, summary FROM advisories_flat",
       ["advisories_flat"])


@query("src_ignore_list", "2.1")
def _(spark, sf):
    g = G.gitignore_lines(files_of(spark, sf))
    return g.select("project", F.posexplode("gi_lines").alias("pos", "entry")).select(
        "project", (F.col("pos") + 1).alias("line"), "entry")


oracle("src_ignore_list", "SELECT project, CAST(generate_subscripts(gi_lines, 1) AS INTEGER) AS line, unnest(gi_lines) AS entry FROM gitignore",
       ["gitignore"])

# ---------------------------------------------------------------------------
# 2.2 line operators
# ---------------------------------------------------------------------------


@query("lines_explode", "2.2")
def _(spark, sf):
    return L.lines_explode(files_of(spark, sf)).select("project", "path", "line", F.length("text").alias("n_chars"))


oracle("lines_explode", "SELECT project, path, unnest(generate_series(1, len(l)))::INTEGER AS line, "
       "CAST(length(unnest(l)) AS INTEGER) AS n_chars FROM (SELECT project, path, string_split(content, chr(10)) AS l FROM files)", ["files"])


@query("snippet_window", "2.2")
def _(spark, sf):
    return C.code_findings(files_of(spark, sf)).select("project", "path", "line", "rule", "snippet")


oracle("snippet_window", "SELECT project, path, line, rule, snippet FROM code_findings", ["code_findings"])


@query("snippet_trim120", "2.2")
def _(spark, sf):
    return S.secret_findings(files_of(spark, sf)).select("project", "path", "line", "snippet")


oracle("snippet_trim120", "SELECT project, path, line, snippet FROM secret_findings", ["secret_findings"])


@query("comment_skip", "2.2")
def _(spark, sf):
    f = FS.without_binary(FS.secret_files(files_of(spark, sf)))
    return L.lines_explode(f).where(L.is_comment_line(F.col("text"))).select("project", "path", "line")


oracle("comment_skip", "SELECT project, path, line FROM (SELECT project, path, unnest(generate_series(1, len(l)))::INTEGER AS line, "
       "unnest(l) AS text FROM (SELECT project, path, string_split(content, chr(10)) AS l FROM secret_src)) "
       f"WHERE starts_with({O.js_trim_sql('text')}, '//') OR starts_with({O.js_trim_sql('text')}, '#!')", ["secret_src"])


@query("match_column", "2.2")
def _(spark, sf):
    return S.secret_findings(files_of(spark, sf)).select("project", "path", "line", "column")


oracle("match_column", 'SELECT project, path, line, "column" FROM secret_findings', ["secret_findings"])


@query("test_file_code", "2.2")
def _(spark, sf):
    f = FS.code_files(files_of(spark, sf))
    return f.select("project", "path", C.is_test_file_code(F.col("path")).alias("is_test"))


oracle("test_file_code", f"SELECT project, path, {oracle_detect.test_file_code_sql()} AS is_test FROM code_src", ["code_src"])

# ---------------------------------------------------------------------------
# 2.3 secrets
# ---------------------------------------------------------------------------


def _hits(spark, sf):
    return S.secret_hits(files_of(spark, sf)).withColumn(
        "rule", F.element_at(F.array(*[F.lit(r.name) for r in S.SECRET_RULES]), F.col("rule_idx") + 1))


@query("secret_match", "2.3")
def _(spark, sf):
    return _hits(spark, sf).select("project", "path", "line", "rule")


oracle("secret_match", "SELECT project, path, line, rule FROM secret_findings", ["secret_findings"])


@query("secret_value", "2.3")
def _(spark, sf):
    return _hits(spark, sf).select("project", "path", "line", "value")


oracle("secret_value", "SELECT project, path, line, value FROM sec_hits", ["sec_hits"])


@query("secret_placeholder", "2.3")
def _(spark, sf):
    """Lines where some rule matched but its value is a placeholder."""
    f = FS.without_binary(FS.secret_files(files_of(spark, sf)))
    lines = L.lines_explode(f).where(~L.is_comment_line(F.col("text")))
    t = F.col("text")
    flags = [t.rlike(S.portable_re(r.pattern, r.flags))
             & is_placeholder(F.regexp_extract(t, S.portable_re(r.pattern, r.flags), r.group)) for r in S.SECRET_RULES]
    any_ph = flags[0]
    for x in flags[1:]:
        any_ph = any_ph | x
    return lines.where(t.rlike(S.combined_prefilter()) & any_ph).select("project", "path", "line")


oracle("secret_placeholder", "SELECT project, path, line FROM sec_lines WHERE " + " OR ".join(
    f"({O.rx('text', S.portable_re(r.pattern, r.flags))} AND "
    f"{O.placeholder_sql(f'regexp_extract(text, {O.q(S.portable_re(r.pattern, r.flags))}, {r.group})')})"
    for r in S.SECRET_RULES), ["sec_lines"])


@query("secret_entropy", "2.3")
def _(spark, sf):
    return _hits(spark, sf).select("project", "path", "line", "rule",
                                   F.round(shannon_entropy(F.col("value")), 6).alias("entropy"))


oracle("secret_entropy", "SELECT project, path, line, rule, entropy FROM secret_findings", ["secret_findings"])


@query("secret_mask", "2.3")
def _(spark, sf):
    return _hits(spark, sf).select("project", "path", "line", mask_value(F.col("value")).alias("masked_value"))


oracle("secret_mask", "SELECT project, path, line, masked_value FROM secret_findings", ["secret_findings"])


@query("secret_confidence", "2.3")
def _(spark, sf):
    return S.secret_findings(files_of(spark, sf)).groupBy("project", "confidence").agg(F.count(F.lit(1)).alias("n"))


oracle("secret_confidence", "SELECT project, confidence, count(*) AS n FROM secret_findings GROUP BY ALL", ["secret_findings"])


@query("env_validate", "2.3")
def _(spark, sf):
    return S.env_validate(files_of(spark, sf)).select("project", "path", "line", "key", "check", "severity", "issue")


def _env_validate_sql():
    envl = ("(SELECT *, regexp_replace(string_split(text, '=')[1], '^\\s+|\\s+$', '', 'g') AS key FROM ("
            "SELECT project, path, unnest(generate_series(1, len(l)))::INTEGER AS line, unnest(l) AS text FROM ("
            "SELECT project, path, string_split(content, chr(10)) AS l FROM files "
            "WHERE starts_with(regexp_extract(path, '[^/]*$', 0), '.env'))) "
            "WHERE NOT starts_with(regexp_replace(text, '^\\s+', ''), '#') AND contains(text, '='))")
    checks = []
    for p, n, sev, fl in S.ENV_RULES:
        pat = S.portable_re(p, fl)
        checks.append(f"SELECT project, path, line, key, {O.q(n)} AS \"check\", {O.q(sev)} AS severity, "
                      f"'Line ' || CAST(line AS VARCHAR) || {O.q(f': [{sev}] {n} detected in ')} || key AS issue "
                      f"FROM {envl} x WHERE {O.rx('text', pat)}")
    return " UNION ALL ".join(checks)


ORACLE["env_validate"] = lambda: O.with_ctes(_env_validate_sql(), ["files"])

# ---------------------------------------------------------------------------
# 2.4 code patterns
# ---------------------------------------------------------------------------
CODE_KEYS = {
    "sast_sql_raw_unsafe": ["sast_sql_raw_unsafe"], "sast_sql_template": ["sast_sql_template"],
    "sast_cmd_member": ["sast_cmd_member"], "sast_cmd_bare": ["sast_cmd_bare"], "sast_eval": ["sast_eval"],
    "sast_function_ctor": ["sast_function_ctor"], "sast_path_traversal": ["sast_path_traversal"],
    "sast_nosql": ["sast_nosql"], "sast_idor": ["sast_idor"], "sast_proto_pollution": ["sast_proto_pollution"],
    "sast_missing_auth": ["sast_missing_auth"], "sast_xss_inner_html": ["sast_xss_inner_html"],
    "sast_hardcoded_cred": ["sast_hardcoded_assign", "sast_hardcoded_decl"],
}


def _code_query(keys):
    def build(spark, sf):
        rules = [C.RULES_BY_KEY[k] for k in keys]
        h = C.code_hits(files_of(spark, sf), include_ref_dead=True, rules=rules)
        return h.select("project", "path", "line", "rule", "column", "message")
    return build


for _k, _keys in CODE_KEYS.items():
    query(_k, "2.4")(_code_query(_keys))
    oracle(_k, "SELECT project, path, line, rule, col AS \"column\", message FROM code_hits_all WHERE key IN ("
           + ", ".join(O.q(x) for x in _keys) + ")", ["code_hits_all"])


@query("sast_findings", "2.4")
def _(spark, sf):
    return C.code_findings(files_of(spark, sf))


oracle("sast_findings", "SELECT * FROM code_findings", ["code_findings"])

# ---------------------------------------------------------------------------
# 2.5 configuration
# ---------------------------------------------------------------------------
IAC_KEYS = {
    "iac_docker_root_user": "dockerfile-root-user", "iac_docker_latest_tag": "dockerfile-latest-tag",
    "iac_docker_secret_env": "dockerfile-secret-in-env", "iac_docker_copy_env": "dockerfile-copy-env",
    "iac_docker_insecure_download": "dockerfile-insecure-download", "iac_docker_no_user": "dockerfile-no-user",
    "iac_compose_privileged": "compose-privileged-container", "iac_compose_port": "compose-port-exposure",
    "iac_compose_secret": "compose-hardcoded-secret", "iac_next_cors": "nextjs-cors-wildcard",
    "iac_next_public_secret": "nextjs-public-secret", "iac_next_svg": "nextjs-dangerous-svg",
    "iac_vercel_cors": "vercel-cors-wildcard", "iac_env_not_ignored": "env-not-gitignored",
}


def _iac_query(rule):
    def build(spark, sf):
        f = G.config_findings(files_of(spark, sf))
        return f.where(F.col("rule") == rule).select("project", "path", "line", "rule", "severity", "message")
    return build


for _k, _rule in IAC_KEYS.items():
    query(_k, "2.5")(_iac_query(_rule))
    oracle(_k, f"SELECT project, path, line, rule, severity, message FROM config_findings WHERE rule = {O.q(_rule)}",
           ["config_findings"])


@query("iac_findings", "2.5")
def _(spark, sf):
    return G.config_findings(files_of(spark, sf))


oracle("iac_findings", "SELECT * FROM config_findings", ["config_findings"])

# ---------------------------------------------------------------------------
# 2.6 dependencies
# ---------------------------------------------------------------------------


def _packages(spark, sf):
    return D.packages_from_manifests(files_of(spark, sf))


def _sca(spark, sf):
    c = corpus_of(spark, sf)
    return D.sca_findings(_packages(spark, sf), c.advisories)


@query("sca_match", "2.6")
def _(spark, sf):
    return D.sca_match(_packages(spark, sf), corpus_of(spark, sf).advisories)


oracle("sca_match", "SELECT * FROM sca_match", ["sca_match"])


@query("version_key", "2.6")
def _(spark, sf):
    """Every version's key, and its place among the versions of its package."""
    p = _packages(spark, sf).select("ecosystem", "name", "version").distinct()
    p = p.withColumn("sort_key", D.version_key(F.col("version"), F.col("ecosystem")))
    place = F.dense_rank().over(Window.partitionBy("ecosystem", "name").orderBy("sort_key")).cast("long")
    return p.withColumn("place", place)


oracle("version_key", f"SELECT *, dense_rank() OVER (PARTITION BY ecosystem, name ORDER BY sort_key) AS place FROM ("
       f"SELECT DISTINCT ecosystem, name, version, {oracle_detect.version_key_sql('version', 'ecosystem')} AS sort_key FROM packages)", ["packages"])


@query("sca_cvss", "2.6")
def _(spark, sf):
    a = corpus_of(spark, sf).advisories
    return a.select("id", D.cvss_score(None).alias("cvss_score"))


oracle("sca_cvss", f"SELECT a.id, {oracle_detect.cvss_sql('a')} AS cvss_score FROM advisories_flat a", ["advisories_flat"])


@query("sca_severity", "2.6")
def _(spark, sf):
    return D.project_counts(_packages(spark, sf), corpus_of(spark, sf).advisories).groupBy("severity").agg(F.sum("n").alias("n"))


oracle("sca_severity", "SELECT severity, count(*) AS n FROM sca_raw GROUP BY severity", ["sca_raw"])


@query("sca_cve", "2.6")
def _(spark, sf):
    return D.sca_cves(_packages(spark, sf), corpus_of(spark, sf).advisories)


oracle("sca_cve", "SELECT DISTINCT project, package_name, installed_version, cve FROM sca_raw", ["sca_raw"])


@query("sca_fixed_version", "2.6")
def _(spark, sf):
    return _sca(spark, sf).select("id", "package_name", "fixed_version", "fix_suggestion")


oracle("sca_fixed_version", "SELECT id, package_name, fixed_version, fix_suggestion FROM sca_raw", ["sca_raw"])


@query("sca_vulnerable_range", "2.6")
def _(spark, sf):
    return _sca(spark, sf).select("id", "vulnerable_range")


oracle("sca_vulnerable_range", "SELECT id, vulnerable_range FROM sca_raw", ["sca_raw"])


@query("sca_exploit", "2.6")
def _(spark, sf):
    return _sca(spark, sf).select("id", "exploit_available")


oracle("sca_exploit", "SELECT id, exploit_available FROM sca_raw", ["sca_raw"])


@query("sca_findings", "2.6")
def _(spark, sf):
    return _sca(spark, sf)


oracle("sca_findings", "SELECT * FROM sca_raw", ["sca_raw"])


@query("sca_check_package", "2.6")
def _(spark, sf):
    """The single-package lookup, run as one batch over every distinct
    (ecosystem, name, version) of the corpus (project-free results)."""
    pk = _packages(spark, sf).select("ecosystem", "name", "version").distinct()
    return D.check_package(corpus_of(spark, sf).advisories, pk, answers=True)


oracle("sca_check_package", "SELECT DISTINCT package_name, installed_version, cve, severity, cvss_score, message, fix_suggestion "
       "FROM sca_raw", ["sca_raw"])


@query("deps_checked", "2.6")
def _(spark, sf):
    return D.dependencies_checked(files_of(spark, sf))


oracle("deps_checked", "SELECT * FROM deps_checked", ["deps_checked"])


@query("dep_health", "2.6")
def _(spark, sf):
    pk = _packages(spark, sf)
    vuln = D.project_counts(pk, corpus_of(spark, sf).advisories).withColumnRenamed("package_name", "name")
    per_pkg = vuln.groupBy("project", "name").agg(
        F.max(F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "high", 4)
              .when(F.col("severity") == "medium", 3).when(F.col("severity") == "low", 2).otherwise(1)).alias("worst"))
    j = pk.select("project", "name").distinct().join(per_pkg, ["project", "name"], "left")
    agg = j.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("worst").isNotNull()).alias("vulnerable"),
        F.count_if(F.col("worst") == 5).alias("critical"), F.count_if(F.col("worst") == 4).alias("high"),
        F.count_if(F.col("worst") == 3).alias("medium"), F.count_if(F.col("worst") <= 2).alias("low"))
    # the report's list: the five worst packages, by name within a severity
    worst_first = Window.partitionBy("project").orderBy(F.desc("worst"), "name")
    top = per_pkg.withColumn("rank", F.row_number().over(worst_first)).where("rank <= 5").groupBy("project").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "name")))["name"], ", ").alias("top_vulnerable"))
    agg = agg.join(top, "project", "left").withColumn("top_vulnerable", F.coalesce("top_vulnerable", F.lit("")))
    return agg.select("project", "total", "vulnerable", (F.col("total") - F.col("vulnerable")).alias("safe"),
                      F.when(F.col("total") > 0, F.floor(F.lit(0.5) + (F.col("total") - F.col("vulnerable")) * 100.0
                                                         / F.col("total"))).otherwise(100).cast("int").alias("percent_healthy"),
                      "critical", "high", "medium", "low", "top_vulnerable")


oracle("dep_health",
       "SELECT project, total, vulnerable, top_vulnerable, total - vulnerable AS safe, "
       "CAST(CASE WHEN total > 0 THEN floor(0.5 + (total - vulnerable) * 100.0::DOUBLE / total) ELSE 100 END AS INTEGER) AS percent_healthy, "
       "critical, high, medium, low FROM (SELECT project, count(*) AS total, count(worst) AS vulnerable, "
       "count(*) FILTER (WHERE worst = 5) AS critical, count(*) FILTER (WHERE worst = 4) AS high, "
       "count(*) FILTER (WHERE worst = 3) AS medium, count(*) FILTER (WHERE worst <= 2) AS low, "
       "coalesce(string_agg(name, ', ' ORDER BY worst DESC, name) FILTER (WHERE worst IS NOT NULL AND nth <= 5), '') AS top_vulnerable FROM ("
       "SELECT p.project, p.name, v.worst, row_number() OVER (PARTITION BY p.project ORDER BY v.worst DESC NULLS LAST, p.name) AS nth FROM (SELECT DISTINCT project, name FROM packages) p LEFT JOIN ("
       "SELECT project, package_name AS name, max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 "
       "WHEN 'low' THEN 2 ELSE 1 END) AS worst FROM sca_raw GROUP BY ALL) v ON p.project = v.project AND p.name = v.name) GROUP BY project)",
       ["packages", "sca_raw"])

# ---------------------------------------------------------------------------
# 2.7 reachability
# ---------------------------------------------------------------------------


@query("imports_extract", "2.7")
def _(spark, sf):
    f = FS.import_files(files_of(spark, sf))
    specs = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in R.IMPORT_PATTERNS])
    return f.select("project", "path", F.explode(specs).alias("spec")).groupBy("project", "path", "spec").agg(
        F.count(F.lit(1)).alias("n"))


oracle("imports_extract", "SELECT project, path, spec, count(*) AS n FROM (SELECT project, path, unnest("
       + " || ".join(f"regexp_extract_all(content, {O.q(p)}, 1)" for p in R.IMPORT_PATTERNS)
       + ") AS spec FROM imp_src) GROUP BY ALL", ["imp_src"])


@query("imports_normalize", "2.7")
def _(spark, sf):
    return R.imports(files_of(spark, sf)).select("project", "package", "file")


oracle("imports_normalize", "SELECT project, package, file FROM imports", ["imports"])


@query("import_map", "2.7")
def _(spark, sf):
    m = R.import_map(R.imports(files_of(spark, sf)))
    return m.select("project", "package", "page", F.array_join("files", ",").alias("files"), "n_files")


oracle("import_map", "SELECT project, package, page, string_agg(file, ',' ORDER BY file) AS files, any_value(n) AS n_files FROM ("
       f"SELECT *, ((row_number() OVER (PARTITION BY project, package ORDER BY file) - 1) // {R.PAGE_FILES} + 1)::INTEGER AS page, "
       "count(*) OVER (PARTITION BY project, package) AS n FROM (SELECT DISTINCT project, package, file FROM imports)) "
       "GROUP BY project, package, page", ["imports"])


@query("function_usage", "2.7")
def _(spark, sf):
    return R.function_usage(files_of(spark, sf))


oracle("function_usage", "SELECT project, package, file FROM imports WHERE risky_used", ["imports"])


@query("reachability", "2.7")
def _(spark, sf):
    pk = R.package_reachability(_packages(spark, sf), files_of(spark, sf))
    r = D.sca_findings(pk, corpus_of(spark, sf).advisories, conform_schema=False)
    return r.select("id", "project", "package_name", "is_reachable", "reachability_reason")


oracle("reachability", "SELECT id, project, package_name, reach_new AS is_reachable, reachability_reason "
       "FROM sca_reach", ["sca_reach"])
