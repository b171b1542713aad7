"""DuckDB SQL oracle: the same queries written independently as SQL.

Each ``queries()`` key gets ``WITH <ctes> SELECT ...`` over the driver's
pre-registered views. The corpus CTEs come from ``sources.corpus`` (same
expressions as the Spark side, so inputs are identical); every operator
below is re-expressed in plain SQL with DuckDB's RE2 regex engine, lists
and window functions, so it checks the Spark operators rather than
repeating them.
"""

from __future__ import annotations

import functools
import re

from ..operators import secrets as S
from ..sources import corpus
from ..sources import files as FS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def entropy_sql(v: str) -> str:
    chars = f"string_split({v}, '')"
    cnt = f"len(list_filter({chars}, lambda x: x = ch))::DOUBLE / length({v})"
    return (f"(CASE WHEN coalesce(length({v}), 0) = 0 THEN 0.0 ELSE "
            f"list_sum(list_transform(list_distinct({chars}), lambda ch: -({cnt}) * log2({cnt}))) END)")


def placeholder_sql(v: str) -> str:
    from ..functions.entropy import PLACEHOLDER_MARKERS
    return "(" + " OR ".join(f"contains(lower({v}), {q(m)})" for m in PLACEHOLDER_MARKERS) + ")"


def mask_sql(v: str) -> str:
    return (f"(CASE WHEN length({v}) <= 8 THEN '****' ELSE substr({v}, 1, 4) || "
            f"repeat('*', least(length({v}) - 8, 20)) || right({v}, 4) END)")


def basename_sql(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$', 0)"


def js_trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def eff_sev() -> str:
    return "coalesce(nullif(contextual_severity, ''), severity)"


def sev_rank(c: str) -> str:
    return (f"(CASE {c} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 "
            f"WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END)")


def conf_rank(c: str) -> str:
    return f"(CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"


def half_up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def grade_sql(s: str) -> str:
    return (f"(CASE WHEN {s} >= 90 THEN 'A+' WHEN {s} >= 80 THEN 'A' WHEN {s} >= 70 THEN 'B' "
            f"WHEN {s} >= 60 THEN 'C' WHEN {s} >= 50 THEN 'D' ELSE 'F' END)")


def band_sql(s: str) -> str:
    return (f"(CASE WHEN {s} >= 80 THEN 'good' WHEN {s} >= 60 THEN 'fair' "
            f"WHEN {s} >= 40 THEN 'poor' ELSE 'critical' END)")


def score_sql(c, h, m, lo, i) -> str:
    ded = f"({c} * 20.0::DOUBLE + {h} * 10.0::DOUBLE + {m} * 3.0::DOUBLE + {lo} * 1.0::DOUBLE + {i} * 0.5::DOUBLE)"
    return f"CAST({half_up(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - {ded}))')} AS INTEGER)"


FINDING_COLS = ["id", "project", "scanner", "rule", "severity", "confidence", "path", "line", "column",
                "message", "cwe", "owasp", "snippet", "fix_suggestion", "secret_type", "entropy",
                "masked_value", "package_name", "installed_version", "vulnerable_range", "fixed_version",
                "cve", "cvss_score", "description", "is_dev_dependency", "is_direct", "is_reachable",
                "exploit_available", "config_file", "scan_ts"]
FINDING_TYPES = {"line": "INTEGER", "column": "INTEGER", "entropy": "DOUBLE", "cvss_score": "DOUBLE",
                 "is_dev_dependency": "BOOLEAN", "is_direct": "BOOLEAN", "is_reachable": "BOOLEAN",
                 "exploit_available": "BOOLEAN", "scan_ts": "TIMESTAMP"}


def conform_sql(present: dict[str, str]) -> str:
    """SELECT list in the findings schema; absent columns are typed NULLs."""
    out = []
    for c in FINDING_COLS:
        t = FINDING_TYPES.get(c, "VARCHAR")
        expr = present.get(c, "NULL")
        out.append(f"CAST({expr} AS {t}) AS \"{c}\"")
    return ", ".join(out)


# ---------------------------------------------------------------------------
# pipeline CTEs
# ---------------------------------------------------------------------------

def _dirs_re(dirs):
    return "(^|/)(" + "|".join(d.replace(".", "\\.") for d in dirs) + ")/"


def secret_ctes() -> dict[str, str]:
    c = {}
    skip = "|".join(f"(?:{FS.java_re(x)})" for x in FS.SECRET_SKIP_PATTERNS if not x.startswith("(?i)"))
    skip_ci = FS.java_re(FS.SECRET_SKIP_PATTERNS[-1])
    c["secret_src"] = (
        f"SELECT * FROM files WHERE NOT {rx('path', _dirs_re(FS.SECRET_IGNORE_DIRS))} "
        f"AND NOT {rx('path', r'\.min\.js\z')} "
        f"AND NOT {rx('path', skip)} AND NOT {rx('path', skip_ci)} AND NOT contains(content, chr(0))")
    c["sec_lines"] = (
        "SELECT project, path, line, text FROM ("
        "SELECT project, path, unnest(generate_series(1, len(l)))::INTEGER AS line, unnest(l) AS text "
        "FROM (SELECT project, path, string_split(content, chr(10)) AS l FROM secret_src)) "
        f"WHERE NOT (starts_with({js_trim_sql('text')}, '//') OR starts_with({js_trim_sql('text')}, '#!'))")
    whens = []
    for i, r in enumerate(S.SECRET_RULES):
        p = S.portable_re(r.pattern, r.flags)
        v = f"regexp_extract(text, {q(p)}, {r.group})"
        cond = f"{rx('text', p)} AND NOT {placeholder_sql(v)}"
        if r.gate is not None:
            cond += f" AND {entropy_sql(v)} >= {r.gate}::DOUBLE"
        whens.append(f"WHEN {cond} THEN {i}")
    c["sec_idx"] = (f"SELECT *, CASE WHEN NOT {rx('text', S.combined_prefilter())} THEN NULL "
                    + " ".join(whens) + " END AS rule_idx FROM sec_lines")
    val = "CASE rule_idx " + " ".join(
        f"WHEN {i} THEN regexp_extract(text, {q(S.portable_re(r.pattern, r.flags))}, {r.group})"
        for i, r in enumerate(S.SECRET_RULES)) + " END"
    mat = "CASE rule_idx " + " ".join(
        f"WHEN {i} THEN regexp_extract(text, {q(S.portable_re(r.pattern, r.flags))}, 0)"
        for i, r in enumerate(S.SECRET_RULES)) + " END"
    c["sec_hits"] = f"SELECT project, path, line, text, rule_idx, {val} AS value, {mat} AS matched FROM sec_idx WHERE rule_idx IS NOT NULL"

    def arr(attr):
        return "[" + ", ".join(q(getattr(r, attr)) for r in S.SECRET_RULES) + "][rule_idx + 1]"
    present = {
        "id": "sha256(concat_ws('|', 'secrets', project, path, CAST(line AS VARCHAR), " + arr("name") + ", ''))",
        "project": "project", "scanner": "'secrets'", "rule": arr("name"), "severity": arr("severity"),
        "confidence": f"CASE WHEN {entropy_sql('value')} > 4.5 THEN 'high' ELSE 'medium' END",
        "path": "path", "line": "line", "column": "instr(text, matched) - 1",
        "message": arr("description") + f" || ' found in ' || {basename_sql('path')}",
        "cwe": q(S.SECRET_CWE), "owasp": q(S.SECRET_OWASP), "snippet": f"substr({js_trim_sql('text')}, 1, 120)",
        "fix_suggestion": q(S.SECRET_FIX), "secret_type": arr("description"),
        "entropy": f"round({entropy_sql('value')}, 6)", "masked_value": mask_sql("value"),
    }
    c["secret_findings"] = f"SELECT {conform_sql(present)} FROM sec_hits"
    return c


def context_ctes() -> dict[str, str]:
    from ..operators import context as C
    c = {}

    def exists(paths):
        cond = " OR ".join(f"path = {q(x)} OR starts_with(path, {q(x + '/')})" for x in paths)
        return f"max(CASE WHEN {cond} THEN 1 ELSE 0 END) = 1"
    aggs = [f"{exists(['/package.json'])} AS _has_pkg", f"{exists(C.MONOREPO_MARKERS)} AS _monorepo_file",
            f"{exists(C.PYTHON_MARKERS)} AS _python", f"{exists(['/' + d for d in C.TEST_DIRS])} AS _tests"]
    aggs += [f"{exists(paths)} AS _deploy{i}" for i, (paths, _, _) in enumerate(C.DEPLOY_RULES)]
    c["ctx_presence"] = f"SELECT project, {', '.join(aggs)} FROM files GROUP BY project"
    c["ctx_pkg"] = (
        "SELECT project, list_filter(coalesce(map_keys(m.dependencies), []), lambda k: length(m.dependencies[k]) > 0) "
        "|| list_filter(coalesce(map_keys(m.devDependencies), []), lambda k: length(m.devDependencies[k]) > 0) AS deps, "
        "m.workspaces AS workspaces, m IS NOT NULL AS _parsed FROM ("
        "SELECT project, CASE WHEN json_valid(content) THEN json_transform(content, "
        "'{\"dependencies\": \"MAP(VARCHAR, VARCHAR)\", \"devDependencies\": \"MAP(VARCHAR, VARCHAR)\", \"workspaces\": \"VARCHAR\"}') END AS m "
        "FROM files WHERE path = '/package.json')")

    def has(n):
        return f"coalesce(list_contains(deps, {q(n)}), false)"

    def any_of(names):
        return "(" + " OR ".join(has(n) for n in names) + ")"
    fw = "list_filter([" + ", ".join(f"CASE WHEN {has(d)} THEN {q(l)} END" for d, l in C.FRAMEWORK_MARKERS) + "], lambda x: x IS NOT NULL)"
    target, public = "'unknown'", "false"
    for i, (_, t, pub) in reversed(list(enumerate(C.DEPLOY_RULES))):
        target = f"CASE WHEN _deploy{i} THEN {q(t)} ELSE {target} END"
        public = f"CASE WHEN _deploy{i} THEN {'true' if pub else 'false'} ELSE {public} END"
    parsed = "coalesce(_parsed, false)"
    c["project_context"] = (
        f"SELECT p.project, ({parsed} AND {any_of(C.DATABASE_PACKAGES)}) AS has_database, "
        f"({parsed} AND {any_of(C.AUTH_PACKAGES)}) AS has_authentication, {public} AS is_publicly_deployed, "
        f"CASE WHEN {parsed} THEN {fw} ELSE []::VARCHAR[] END AS frameworks, "
        f"({parsed} AND (workspaces IS NOT NULL OR _monorepo_file)) AS is_monorepo, _tests AS has_tests, "
        f"{target} AS deploy_target, "
        f"(CASE WHEN {parsed} AND {has('typescript')} THEN ['typescript'] ELSE []::VARCHAR[] END) || "
        f"(CASE WHEN {parsed} THEN ['javascript'] ELSE []::VARCHAR[] END) || "
        f"(CASE WHEN _python THEN ['python'] ELSE []::VARCHAR[] END) AS language "
        "FROM ctx_presence p LEFT JOIN ctx_pkg k ON p.project = k.project")
    return c


def triage_ctes(src: str, prefix: str) -> dict[str, str]:
    """context rules -> dedup flags -> priority over findings CTE ``src``."""
    from ..operators import triage as T
    c = {}
    test_file = ("(regexp_matches(path, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') OR contains(path, '__tests__') "
                 "OR contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '/spec/'))")
    fe = "['" + "', '".join(T.FRONTEND_FRAMEWORKS) + "']"
    se = "['" + "', '".join(T.SERVER_FRAMEWORKS) + "']"
    frontend = f"(list_has_any(coalesce(x.frameworks, []), {fe}) AND NOT list_has_any(coalesce(x.frameworks, []), {se}))"
    dev = "coalesce(is_dev_dependency, false)"
    expl = "coalesce(exploit_available, false)"
    reach = "coalesce(is_reachable, false)"
    pub = "coalesce(x.is_publicly_deployed, false)"
    db = "coalesce(x.has_database, false)"
    r1 = f"(scanner = 'secrets' AND {test_file})"
    r2 = f"(scanner = 'sca' AND {dev} AND coalesce(cvss_score < 4.0, false) AND NOT {expl})"
    r3 = f"(scanner = 'sca' AND {dev} AND NOT {reach})"
    r4 = f"(scanner = 'sast' AND rule = 'sql-injection-template-literal' AND {frontend})"
    r8 = f"(scanner = 'sca' AND coalesce(cvss_score < 3.0, false) AND NOT {expl} AND NOT {reach})"
    r5 = f"(scanner = 'sast' AND rule = 'missing-auth-middleware' AND NOT {pub})"
    r6 = f"(scanner = 'sast' AND contains(rule, 'sql-injection') AND {db})"
    r7 = f"((scanner = 'secrets' OR rule = 'hardcoded-credentials') AND {pub})"
    reason = (f"CASE WHEN {r1} THEN {q(T.REASON_TEST_SECRET)} WHEN {r2} THEN {q(T.REASON_DEV_LOW)} "
              f"WHEN {r3} THEN {q(T.REASON_DEV_UNREACHABLE)} WHEN {r4} THEN {q(T.REASON_FRONTEND_SQL)} "
              f"WHEN {r8} THEN {q(T.REASON_LOW_CVSS)} END")
    sev = (f"CASE WHEN {r1} OR {r2} OR {r3} OR {r4} THEN NULL WHEN {r7} THEN 'critical' "
           f"WHEN {r6} THEN 'critical' WHEN {r5} THEN 'medium' END")
    c[f"{prefix}_ctx"] = (
        f"SELECT f.*, ({reason}) IS NOT NULL AS auto_ignored, {reason} AS auto_ignore_reason, "
        f"{sev} AS contextual_severity FROM {src} f LEFT JOIN project_context x ON f.project = x.project")
    key = ("CASE WHEN scanner = 'sca' THEN 'sca:cve:' || coalesce(cve, 'undefined') "
           "WHEN scanner = 'secrets' THEN 'secrets:' || coalesce(secret_type, 'undefined') || ':' || coalesce(masked_value, 'unknown') "
           "ELSE concat_ws(':', scanner, path, CAST(line AS VARCHAR), rule) END")
    score = f"({sev_rank('severity')} * 10 + {conf_rank('confidence')})"
    scan = "coalesce(strftime(scan_ts, '%Y-%m-%d %H:%M:%S.%f'), '')"
    c[f"{prefix}_keyed"] = (
        f"SELECT *, {key} AS group_key, {scan} AS _scan, row_number() OVER (PARTITION BY project, {scan}, {key} "
        f"ORDER BY {score} DESC, path NULLS FIRST, line NULLS FIRST, \"column\" NULLS FIRST, rule NULLS FIRST, id NULLS FIRST) AS _rn, "
        f"count(*) OVER (PARTITION BY project, {scan}, {key}) AS _gsize FROM {prefix}_ctx")
    c[f"{prefix}_triaged"] = (
        # a window instead of a join of the keyed rows with themselves, which DuckDB does not end under a LIMIT
        f"SELECT * EXCLUDE (_rn, _gsize, _scan, _primary), id <> _primary AS is_duplicate, "
        f"CASE WHEN id <> _primary THEN _primary END AS duplicate_of "
        f"FROM (SELECT *, first_value(id) OVER (PARTITION BY project, _scan, group_key ORDER BY _rn) AS _primary FROM {prefix}_keyed)")
    w = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0, "info": 5.0}
    sev_s = "CASE " + eff_sev() + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in w.items()) + " ELSE 0.0::DOUBLE END"
    has = lambda s: f"contains(rule, '{s}')"
    base = "cvss_score / 10 * 100"
    expl_s = (f"CASE WHEN scanner = 'sca' THEN CASE WHEN {expl} THEN least(100.0::DOUBLE, ({base}) * 1.3::DOUBLE) ELSE {base} END "
              "WHEN scanner = 'secrets' THEN 90.0::DOUBLE "
              f"WHEN scanner = 'sast' THEN CASE WHEN {has('sql-injection')} OR {has('command-injection')} THEN 90.0::DOUBLE "
              f"WHEN {has('xss')} THEN 75.0::DOUBLE WHEN {has('path-traversal')} THEN 70.0::DOUBLE WHEN {has('idor')} THEN 65.0::DOUBLE "
              f"WHEN {has('hardcoded')} THEN 80.0::DOUBLE ELSE 50.0::DOUBLE END "
              f"WHEN scanner = 'iac' THEN CASE WHEN {has('secret')} OR {has('env')} THEN 85.0::DOUBLE "
              f"WHEN {has('privileged')} THEN 80.0::DOUBLE WHEN {has('root')} THEN 70.0::DOUBLE ELSE 40.0::DOUBLE END "
              "ELSE 50.0::DOUBLE END")
    reach_s = ("CASE WHEN is_reachable IS NULL THEN CASE WHEN scanner = 'sca' THEN 60.0::DOUBLE ELSE 80.0::DOUBLE END "
               "WHEN is_reachable THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END")
    imp = ("CASE scanner WHEN 'secrets' THEN 100.0::DOUBLE WHEN 'sast' THEN 80.0::DOUBLE WHEN 'sca' THEN 60.0::DOUBLE "
           "WHEN 'iac' THEN 50.0::DOUBLE WHEN 'quality' THEN 30.0::DOUBLE ELSE 50.0::DOUBLE END")
    mult = ("CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.85::DOUBLE WHEN 'low' THEN 0.65::DOUBLE "
            "ELSE 0.7::DOUBLE END")
    boosted = f"CASE WHEN contextual_severity = 'critical' AND severity <> 'critical' THEN ({mult}) * 1.2::DOUBLE ELSE {mult} END"
    imp_s = f"least(100.0::DOUBLE, ({imp}) * ({boosted}))"
    c[f"{prefix}_pscored"] = (
        f"SELECT *, {sev_s} AS _s, {expl_s} AS _e, {reach_s} AS _r, {imp_s} AS _b FROM {prefix}_triaged "
        "WHERE NOT coalesce(auto_ignored, false) AND NOT coalesce(is_duplicate, false)")
    raw = "_s * 0.40::DOUBLE + _e * 0.25::DOUBLE + _r * 0.20::DOUBLE + _b * 0.15::DOUBLE"
    c[f"{prefix}_prioritized"] = (
        f"SELECT * EXCLUDE (_s, _e, _r, _b), CAST({half_up(f'least(100.0::DOUBLE, greatest(0.0::DOUBLE, {raw}))')} AS INTEGER) AS priority_score, "
        f"{{'severity_score': CAST({half_up('_s')} AS INTEGER), 'exploitability_score': CAST({half_up('_e')} AS INTEGER), "
        f"'reachability_score': CAST({half_up('_r')} AS INTEGER), 'business_impact_score': CAST({half_up('_b')} AS INTEGER)}} AS priority_factors "
        f"FROM {prefix}_pscored")
    return c


def active_sql() -> str:
    return "(NOT coalesce(auto_ignored, false) AND NOT coalesce(is_duplicate, false))"


def sev_counts_select() -> str:
    a = active_sql()
    return ", ".join(f"CAST(count(*) FILTER (WHERE {a} AND {eff_sev()} = '{s}') AS BIGINT) AS {s}"
                     for s in ["critical", "high", "medium", "low", "info"])


def all_ctes() -> dict[str, str]:
    c = dict(corpus.duck_ctes())
    c.update(secret_ctes())
    c.update(context_ctes())
    c.update(extra_ctes())
    return c


_EXTRA: list = []


def register_ctes(fn):
    """Later modules add their CTE builders here (kept in registration order)."""
    _EXTRA.append(fn)
    return fn


def extra_ctes() -> dict[str, str]:
    out = {}
    for fn in _EXTRA:
        out.update(fn())
    return out


def with_ctes(select: str, needed: list[str] | None = None) -> str:
    c = _tables()[0] if needed is None else _closure(needed)
    kept = lambda k: "MATERIALIZED " if k in MATERIALIZED else ""
    return "WITH " + ",\n".join(f"{k} AS {kept(k)}({v})" for k, v in c.items()) + "\n" + select


#: Tables that are used more than once and costly.
MATERIALIZED: set[str] = set()


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, set[str]]]:
    """All tables, and those that each one reads."""
    c = all_ctes()
    return c, {k: (set(re.findall(r"\w+", body)) & c.keys()) - {k} for k, body in c.items()}


def _closure(needed: list[str]) -> dict[str, str]:
    c, reads = _tables()
    keep, todo = set(), [n for n in needed if n in c]
    while todo:
        n = todo.pop()
        if n not in keep:
            keep.add(n)
            todo += reads[n]
    return {k: v for k, v in c.items() if k in keep}
