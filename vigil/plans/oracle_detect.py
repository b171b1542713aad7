"""DuckDB oracle CTEs for code, configuration, dependency and reachability
detection (registered into ``oracle.all_ctes``)."""

from __future__ import annotations

from ..operators import code as C
from ..operators import config as G
from ..operators import deps as D
from ..operators import reach as R
from ..operators import spans as SP
from ..functions import versions as V
from ..sources import files as FS
from . import oracle as O
from .oracle import conform_sql, js_trim_sql, q, rx


def _dirs(dirs):
    return "(^|/)(" + "|".join(d.replace(".", "\\.") for d in dirs) + ")/"


def _b(p="path"):
    return f"regexp_extract({p}, '[^/]*$', 0)"


def test_file_code_sql(p="path"):
    return (f"(regexp_matches({_b(p)}, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') OR contains({p}, '__tests__') "
            f"OR contains({p}, '__mocks__'))")


def _exists_word(col, words):
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _p(pattern: str) -> str:
    """A pattern of the rules as RE2 takes it, quoted."""
    return q(pattern.replace("*+", "*").replace("++", "+"))


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_p(pattern)}, {q(to)}, 'g')"


def _trimmed(x: str) -> str:
    return _sub(x, r"^\s+|\s+$", "")


def _shape(x: str) -> str:
    out = _sub(x, SP.STRINGS, r"\1\1\2\2\3\3")
    for _ in range(SP.NESTING):
        out = _sub(out, r"\([^()]+\)", "()")
    return out


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_p(pattern)})"


def _input(s: str) -> str:
    return f"({_is(s, C.IS_INPUT_NAME)} OR ({_is(s, C.IS_CHAIN)} AND {_is(s, C.ENDS_IN_INPUT)}))"


def _interpolated(s: str) -> str:
    return f"({_input(s)} OR {_input(_sub(s, C.LAST_STEP, ''))})"


def _some(items: str, test) -> str:
    return f"len(list_filter({items}, lambda z: {test('z')})) > 0"


def _code_args(r: C.CodeRule) -> str:
    """The test of a call's arguments, over columns args (texts) and shapes."""
    a, s = "coalesce(args[1], '')", "coalesce(shapes[1], '')"
    said = f"CASE WHEN {_is(s, C.IS_STRING)} THEN substr({a}, 2, length({a}) - 2) ELSE '' END"
    template = (f"({_is(s, C.IS_TEMPLATE)} AND " + _some(
        f"regexp_extract_all({a}, {_p(C.INTERPOLATION)}, 1)", lambda z: _interpolated(_trimmed(_shape(z)))) + ")")
    flat = _sub(_sub(s, r"\{[^{}]*\}", "{}"), r"\[[^\[\]]*\]", "[]")
    binary = f"({_is(flat, C.BINARY)} AND NOT {_is(flat, C.LOWER)})"
    is_input = _input(s)
    if r.key == "sast_sql_raw_unsafe":
        return f"({_is(s, C.IS_TEMPLATE)} OR {binary})"
    if r.key == "sast_sql_template":
        return template
    if r.key == "sast_cmd_member":
        return f"({template} OR {is_input} OR {binary})"
    if r.key == "sast_cmd_bare":
        return f"({template} OR {is_input})"
    if r.key == "sast_eval":
        return f"len(args) > 0 AND NOT {_is(s, C.IS_STRING)}"
    if r.key == "sast_function_ctor":
        return _some("shapes", lambda z: f"NOT {_is(z, C.IS_STRING)}")
    if r.key == "sast_path_traversal":
        inner = _shape(f"regexp_extract({a}, {_p(C.PATH_JOIN)}, 1)")
        pieces = f"string_split({_sub(_sub(inner, r'\{[^{}]*\}', '{}'), r'\[[^\[\]]*,[^\[\]]*\]', '[]')}, ',')"
        return f"({is_input} OR {template} OR {_some(pieces, lambda z: _input(_trimmed(z)))})"
    if r.key == "sast_nosql":
        return is_input
    if r.key == "sast_idor":
        return f"({_is(s, C.IS_CHAIN)} AND {_is(s, C.ENDS_IN_PARAMS)})"
    if r.key == "sast_proto_pollution":
        return _some("shapes[2:]", _input)
    if r.key == "sast_missing_auth":
        auth = ", ".join(q(x) for x in C.AUTH_MIDDLEWARE)
        has = _some("args[2:len(args) - 1]", lambda z: f"regexp_extract({z}, {_p(C.MIDDLEWARE)}, 1) IN ({auth})")
        return f"len(args) >= 2 AND {_is(said, C.SENSITIVE_ROUTE)} AND NOT ({has}) AND NOT {test_file_code_sql()}"
    if r.key == "sast_xss_inner_html":
        value = f"regexp_extract({s}, {_p(C.HTML_VALUE)}, 1)"
        return (f"CASE WHEN starts_with({s}, '{{') THEN {value} <> '' AND NOT {_is(value, C.HTML_STRING)} "
                f"ELSE {a} NOT IN ('', 'null') END")
    raise KeyError(r.key)


def _code_called(r: C.CodeRule) -> str:
    out = _is("callee", r.callee)
    if r.key == "sast_xss_inner_html":
        return out + " AND opened = '{'"
    out += " AND opened = '(' AND NOT starts_with(callee, '?')"
    if r.key != "sast_function_ctor":
        out += " AND NOT starts_with(callee, 'new ')"
    if r.key in ("sast_cmd_bare", "sast_eval"):
        out += f" AND NOT {_is('prefix', C.DECLARES)} AND NOT {_is('after', C.OPENS_BODY)}"
    return out


def _code_texts(r: C.CodeRule) -> tuple[str, str]:
    a, s = "coalesce(args[1], '')", "coalesce(shapes[1], '')"
    values = {"{method}": f"regexp_extract(callee, {_p(r.callee)}, 1)",
              "{route}": f"CASE WHEN {_is(s, C.IS_STRING)} THEN substr({a}, 2, length({a}) - 2) ELSE '' END"}
    out = []
    for text in (r.message, r.fix):
        sql = q(text)
        for name, value in values.items():
            if name in text:
                sql = f"replace({sql}, {q(name)}, {value})"
        out.append(sql)
    return out[0], out[1]


def _credentials(r: C.CodeRule) -> str:
    declared = r.key == "sast_hardcoded_decl"
    words, ph = (C.CRED_WORDS_DECL, C.CRED_PLACEHOLDERS_DECL) if declared else (C.CRED_WORDS_ASSIGN, C.CRED_PLACEHOLDERS_ASSIGN)
    where = _is("prefix", C.DECLARED) if declared else (
        f"NOT {_is('prefix', C.IN_DECLARATION)} AND {_is('prefix', C.BEGINS)} AND before NOT IN ('(', ',')")
    name = "own" if declared else "lower(own)"
    hit = (f"SELECT f, project, path, content, {q(r.key)} AS key, off + length(prefix) AS pos, "
           f"replace({q(r.message)}, '{{name}}', {name}) AS message, {q(r.fix)} AS fix FROM ("
           f"SELECT *, regexp_extract(name, '[\\w$]+$', 0) AS own, left(g, (length(g) - length(whole) + instr(whole, name) - 1)::BIGINT) AS prefix FROM ("
           f"SELECT *, regexp_extract(g, {_p(r.callee)}, 0) AS whole, regexp_extract(g, {_p(r.callee)}, 1) AS name, "
           "substr(t, 2, length(t) - 2) AS value, coalesce(lag(k) OVER w, '') AS before, coalesce(lead(g) OVER w, '') AS following "
           "FROM code_units WINDOW w AS (PARTITION BY f ORDER BY i)) x "
           f"WHERE k IN ({q(chr(39))}, {q(chr(34))}) AND {_is('g', r.callee)}) y ")
    return (hit + f"WHERE {where} AND NOT {_is('following', C.CONTINUES)} AND {_exists_word('lower(own)', words)} "
            f"AND length(value) > 4 AND NOT {_exists_word('lower(value)', ph)}")


O.MATERIALIZED |= {"code_cut", "code_units", "code_marks", "code_pairs", "code_calls"}


def code_ctes() -> dict[str, str]:
    """Calls by window functions over the marks of each file: depth as a running count, the bracket that closes as the next
    one of its depth, an expression's start as the last one known there."""
    c = {}
    some = " OR ".join([f"contains(content, {q(x)})" for x in C.CALLEE_TOKENS] + [_is("content", r"=\s*['\"]")])
    c["code_cut"] = (f"SELECT row_number() OVER () AS f, project, path, content, regexp_extract_all(content, {_p(SP.MARKS)}) AS toks, "
                     f"string_split_regex(content, {_p(SP.MARKS)}) AS gaps FROM code_src WHERE {some}")
    c["code_units"] = (
        "SELECT *, (sum(length(g) + length(t)) OVER (PARTITION BY f ORDER BY i) - length(g) - length(t))::BIGINT AS off, "
        "sum(CASE WHEN k IN ('(', '[', '{') THEN 1 WHEN k IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY f ORDER BY i) AS depth FROM ("
        "SELECT *, left(t, 1) AS k FROM (SELECT f, project, path, content, i, gaps[i] AS g, coalesce(toks[i], '') AS t FROM ("
        "SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM code_cut)))")
    callee = lambda n: (f"CASE WHEN k = '{{' THEN regexp_extract(g, {_p(SP.ATTRIBUTE)}, {n}) "  # noqa: E731
                        f"ELSE regexp_extract(g, {_p(SP.CHAIN)}, {n}) END")
    c["code_marks"] = (
        "SELECT *, k IN ('(', '[', '{') AS opens, depth + (k IN (')', ']', '}'))::INT AS inside FROM ("
        "SELECT *, lag(k) OVER w AS before_k, lag(off) OVER w + length(lag(g) OVER w) AS before_at, lag(off) OVER w + length(lag(prefix) OVER w) AS before_head, lag(chain) OVER w AS before_chain FROM ("
        f"SELECT *, left(g, (length(g) - length({callee(0)}))::BIGINT) AS prefix, {callee(1)} AS chain FROM code_units) "
        "WINDOW w AS (PARTITION BY f ORDER BY i)) WHERE k IN ('(', '[', '{', ')', ']', '}', ',')")
    goes_on = _is("prefix", r"\.\s*$")
    c["code_open"] = (
        f"SELECT *, coalesce(last_value(CASE WHEN NOT opens THEN NULL WHEN NOT {goes_on} THEN off + length(prefix) "
        "WHEN before_k = '/' THEN CASE WHEN before_chain <> '' THEN before_head END WHEN before_k NOT IN (')', ']', '}') THEN before_at END IGNORE NULLS) OVER (PARTITION BY f, inside ORDER BY i "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), off + length(prefix)) AS pos FROM code_marks")
    c["code_pairs"] = (
        "SELECT * FROM (SELECT *, lead(i) OVER w AS close_i, lead(opens) OVER w AS next_opens FROM code_open WHERE k <> ',' "
        f"WINDOW w AS (PARTITION BY f, inside ORDER BY i)) WHERE opens AND NOT next_opens AND {_is('g', C.WATCHED)}")
    c["code_calls"] = (
        "SELECT *, list_transform(args, lambda z: " + _shape("z") + ") AS shapes FROM ("
        "SELECT f, i, project, path, content, opened, prefix, pos, callee, after, "
        "CASE WHEN args[-1] = '' THEN args[1:len(args) - 1] ELSE args END AS args FROM ("
        "SELECT p.f, p.i, any_value(p.project) AS project, any_value(p.path) AS path, any_value(p.content) AS content, any_value(p.k) AS opened, "
        "any_value(p.prefix) AS prefix, any_value(p.pos) AS pos, any_value(CASE WHEN " + _is("p.prefix", r"\?\.\s*$") + " THEN '?.' WHEN "
        + _is("p.prefix", r"\.\s*$") + " THEN '.' ELSE '' END || CASE WHEN " + _is("p.chain", r"^new\s") + " THEN 'new ' ELSE '' END || "
        + _sub(_sub("p.chain", r"^new\s+", ""), r"[\s!]", "") + ") AS callee, any_value(n.g || n.k) AS after, "
        "list(" + _trimmed(_sub("substr(p.content, (b.from_at + 1)::BIGINT, (b.to_at - b.from_at)::BIGINT)", SP.COMMENTS, "\\1")) + " ORDER BY b.from_at) AS args "
        "FROM code_pairs p JOIN code_units n ON n.f = p.f AND n.i = p.close_i + 1 JOIN ("
        "SELECT p.f, p.i, m.off + length(m.g) + length(m.t) AS from_at, lead(m.off + length(m.g)) OVER (PARTITION BY p.f, p.i ORDER BY m.i) AS to_at "
        "FROM code_pairs p JOIN code_marks m ON m.f = p.f AND m.inside = p.inside AND m.i BETWEEN p.i AND p.close_i) b "
        "ON b.f = p.f AND b.i = p.i AND b.to_at IS NOT NULL GROUP BY p.f, p.i))")
    found = []
    for r in C.CODE_RULES:
        if r.key in C.ARGUMENTS:
            msg, fix = _code_texts(r)
            found.append(f"SELECT f, project, path, content, {q(r.key)} AS key, pos, {msg} AS message, {fix} AS fix FROM code_calls "
                         f"WHERE {_code_called(r)} AND {_code_args(r)}")
        else:
            found.append(_credentials(r))
    meta = ", ".join(f"({n}, {q(r.key)}, {q(r.rule)}, {q(r.severity)}, {q(r.confidence)}, {q(r.cwe)}, {q(r.owasp)}, {str(r.ref_dead).lower()})"
                     for n, r in enumerate(C.CODE_RULES))
    c["code_rules"] = f"SELECT * FROM (VALUES {meta}) v(nr, key, rule, severity, confidence, cwe, owasp, dead)"
    c["code_fired"] = " UNION ALL ".join(found)
    c["code_placed"] = (
        "SELECT *, string_split(content, chr(10)) AS lines, (1 + length(said) - length(replace(said, chr(10), '')))::INTEGER AS line, "
        "length(string_split(said, chr(10))[-1])::INTEGER AS col FROM (SELECT *, left(content, pos::BIGINT) AS said FROM code_fired) JOIN code_rules USING (key)")
    first = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY col, nr) AS n FROM code_placed{where}) WHERE n = 1"
    c["code_hits_all"] = first.format(by="f, line, rule, key IN ('sast_cmd_member'), key IN ('sast_cmd_bare')", where="")
    c["code_hits"] = first.format(by="f, line, rule", where=" WHERE NOT dead")
    present = {
        "id": "sha256(concat_ws('|', 'sast', project, path, CAST(line AS VARCHAR), rule, ''))",
        "project": "project", "scanner": "'sast'", "rule": "rule", "severity": "severity",
        "confidence": "confidence", "path": "path", "line": "line", "column": "col", "message": "message",
        "cwe": "cwe", "owasp": "owasp", "fix_suggestion": "fix",
        "snippet": "array_to_string(lines[greatest(line - 2, 1):least(line + 2, len(lines))], chr(10))",
    }
    c["code_findings"] = f"SELECT {conform_sql(present)} FROM code_hits"
    return c


def version_key_sql(v: str, ecosystem: str) -> str:
    """Sort keys of versions, written apart from the Spark side's: a number as its length and digits."""
    num = lambda x: f"(lpad(length(ltrim({x}, '0'))::VARCHAR, 4, '0') || ltrim({x}, '0'))"
    core = lambda x: (
        f"(regexp_replace(list_aggregate(list_transform(string_split({x}, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') "
        f"THEN ',' || {num('p')} ELSE ',0000' END), 'string_agg', '') || '!', '(,0000)+!$', '!'))")
    pre = f"regexp_extract({v}, {q(V.SEMVER_PRE)}, 1)"
    ids = (f"list_aggregate(list_transform(string_split({pre}, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '1' || {num('p')} "
           "ELSE '2' || p || '!' END), 'string_agg', '')")
    semver = f"({core(f'regexp_extract({v}, {q(V.SEMVER_CORE)}, 1)')} || CASE WHEN {pre} = '' THEN '~' ELSE '-' || {ids} || '0' END)"
    g = lambda i: f"regexp_extract(lower({v}), {_p(V.PEP440)}, {i})"
    phase = "CASE " + g(3) + " " + " ".join(f"WHEN {q(k)} THEN '{n}'" for k, n in V.PHASES.items()) + " END"
    post, dev = f"({g(5)} <> '' OR {g(7)} <> '')", f"{g(8)} <> ''"
    post_key, dev_key = f"'6' || {num(g(6) + ' || ' + g(7))}", f"'1' || {num(g(9))}"
    pep = (f"({num(g(1))} || {core(g(2))} || CASE WHEN {g(3)} <> '' THEN {phase} || {num(g(4))} WHEN {post} THEN {post_key} WHEN {dev} THEN {dev_key} ELSE '5' END "
           f"|| CASE WHEN {g(3)} <> '' AND {post} THEN {post_key} WHEN ({g(3)} <> '' OR {post}) AND {dev} THEN {dev_key} ELSE '5' END "
           f"|| CASE WHEN {g(3)} <> '' AND {post} AND {dev} THEN {dev_key} ELSE '5' END)")
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {ecosystem} = 'PyPI' AND regexp_matches(lower({v}), {_p(V.PEP440)}) THEN {pep} "
            f"WHEN {ecosystem} = 'PyPI' THEN '0000' || {semver} ELSE {semver} END")


def cvss_sql(a: str) -> str:
    return (f"coalesce(CASE WHEN {a}.db_cvss IS NOT NULL AND {a}.db_cvss <> 0 THEN {a}.db_cvss "
            f"WHEN {a}.sev_type IN ('CVSS_V3', 'CVSS_V2') AND {rx(a + '.sev_score', D.CVSS_TRAILING)} "
            f"THEN TRY_CAST(regexp_extract({a}.sev_score, {q(D.CVSS_TRAILING)}, 1) AS DOUBLE) "
            f"WHEN {a}.sev_type IN ('CVSS_V3', 'CVSS_V2') AND {rx(a + '.sev_score', D.CVSS_BASE)} "
            f"THEN TRY_CAST(regexp_extract(regexp_extract({a}.sev_score, {q(D.CVSS_BASE)}, 1), '^\\d*\\.?\\d*', 0) AS DOUBLE) END, 5.0::DOUBLE)")


@O.register_ctes
def detect_ctes() -> dict[str, str]:
    c = {}
    # ---- code ----------------------------------------------------------
    c["code_src"] = (f"SELECT * FROM files WHERE {rx('path', r'\.(js|jsx|ts|tsx)$')} "
                     f"AND NOT {rx('path', _dirs(FS.CODE_IGNORE_DIRS))} AND NOT {rx('path', r'\.min\.js$')} "
                     f"AND NOT {rx('path', r'\.d\.ts$')} AND NOT {rx('path', r'(^|/)\.')}")
    c.update(code_ctes())
    # ---- config --------------------------------------------------------
    b = _b()
    kind = (f"CASE WHEN {b} = 'Dockerfile' OR starts_with({b}, 'Dockerfile.') THEN 'dockerfile' "
            f"WHEN starts_with({b}, 'docker-compose') THEN 'compose' WHEN starts_with({b}, 'next.config') THEN 'nextconfig' "
            f"WHEN {b} = 'vercel.json' THEN 'vercel' WHEN starts_with({b}, '.env') THEN 'dotenv' END")
    c["cfg"] = (f"SELECT project, path, content, {kind} AS kind FROM files WHERE {rx(b, FS.CONFIG_NAME_RE)} "
                f"AND NOT {rx(b, FS.CONFIG_EXCLUDE_NAME_RE)} AND NOT {rx('path', _dirs(FS.CONFIG_IGNORE_DIRS))}")
    c["cfg_lines"] = ("SELECT project, path, kind, l AS lines, unnest(generate_series(1, len(l)))::INTEGER AS line, unnest(l) AS text "
                      "FROM (SELECT project, path, kind, string_split(content, chr(10)) AS l FROM cfg)")

    def fnd(rule, src, line="line", message=None):
        sev, conf, cwe, msg, fix = G.IAC[rule]
        present = {
            "id": f"sha256(concat_ws('|', 'iac', project, path, CAST({line} AS VARCHAR), {q(rule)}, ''))",
            "project": "project", "scanner": "'iac'", "rule": q(rule), "severity": q(sev), "confidence": q(conf),
            "path": "path", "line": line, "message": message or q(msg), "cwe": q(cwe), "owasp": q(G.OWASP_A05),
            "fix_suggestion": q(fix), "config_file": _b(),
        }
        return f"SELECT {conform_sql(present)} FROM {src}"
    t = "text"
    user_line = f"starts_with(upper({js_trim_sql(t)}), 'USER ')"
    user_part = f"lower({js_trim_sql(f'substr({js_trim_sql(t)}, 6)')})"
    image = f"regexp_extract({t}, '(?i)^FROM\\s+(\\S+)', 1)"
    env_part = f"regexp_extract({t}, '(?i)^ENV\\s+(.+)', 1)"
    dl = "(SELECT * FROM cfg_lines WHERE kind = 'dockerfile')"
    c["iac_docker"] = " UNION ALL ".join([
        fnd("dockerfile-root-user", f"{dl} WHERE {user_line} AND {user_part} IN ('root', '0')"),
        fnd("dockerfile-latest-tag",
            f"{dl} WHERE {rx(t, '(?i)^FROM\\s+\\S')} AND (contains({image}, ':latest') OR (NOT contains({image}, ':') AND NOT starts_with({image}, 'scratch')))",
            message=f"'Dockerfile uses unstable image tag ''' || {image} || '''. Using :latest or no tag is not reproducible'"),
        fnd("dockerfile-secret-in-env",
            f"{dl} WHERE {rx(t, '(?i)^ENV\\s+.')} AND {rx(env_part, G.DOCKER_ENV_SECRET)}"),
        fnd("dockerfile-copy-env", f"{dl} WHERE {rx(js_trim_sql(t), '^COPY\\s+.*\\.env')}"),
        fnd("dockerfile-insecure-download", f"{dl} WHERE {rx(t, '(?i)RUN.*(wget|curl).*http://')}"),
        fnd("dockerfile-no-user",
            f"(SELECT project, path FROM {dl} GROUP BY project, path "
            f"HAVING max(CASE WHEN {user_line} AND {user_part} NOT IN ('root', '0') THEN 1 ELSE 0 END) = 0)", line="1"),
    ])
    body = js_trim_sql(f"regexp_replace({t}, {_p(G.YAML_COMMENT)}, '\\1')")
    unq = lambda x: f"regexp_replace({js_trim_sql(x)}, '^\"(.*)\"$|^''(.*)''$', '\\1\\2')"
    c["compose_l"] = (
        f"SELECT *, regexp_matches(body, '^-(\\s|$)') AS item, CASE WHEN regexp_matches(body, '^-(\\s|$)') THEN '' ELSE regexp_extract(body, {q(G.YAML_KEY)}, 1) END AS key FROM ("
        f"SELECT project, path, line, {body} AS body, length({t}) - length(regexp_replace({t}, '^\\s+', '')) AS indent FROM cfg_lines WHERE kind = 'compose') "
        "WHERE length(body) > 0 AND NOT starts_with(body, '#')")
    # by joins: the services key, the service and the property above a line are the last ones before it
    c["compose_top"] = ("SELECT l.*, (SELECT arg_max(a.key, a.line) FROM compose_l a WHERE a.project = l.project AND a.path = l.path AND a.line <= l.line "
                        "AND a.indent = 0 AND a.key <> '') AS top FROM compose_l l")
    c["compose_in"] = ("SELECT *, min(indent) OVER (PARTITION BY project, path) AS si FROM compose_top WHERE top = 'services' AND indent > 0")
    c["compose_svc"] = ("SELECT * FROM (SELECT l.*, (SELECT max(a.line) FROM compose_in a WHERE a.project = l.project AND a.path = l.path AND a.line <= l.line "
                        "AND a.indent = a.si AND a.key <> '') AS sline FROM compose_in l) WHERE sline IS NOT NULL AND indent > si")
    c["compose_own"] = "SELECT *, min(indent) OVER (PARTITION BY project, path, sline) AS pi FROM compose_svc"
    c["compose_p"] = ("SELECT l.*, (SELECT max(a.line) FROM compose_own a WHERE a.project = l.project AND a.path = l.path AND a.sline = l.sline AND a.line <= l.line "
                      "AND a.indent = a.pi AND a.key <> '') AS pline FROM compose_own l")
    inline = js_trim_sql(f"regexp_replace(l.body, {q(G.YAML_KEY)}, '')")
    opened = js_trim_sql(f"regexp_replace(p.body, {q(G.YAML_KEY)}, '')")
    flow = lambda x: ("list_filter(list_transform(string_split(regexp_replace(" + x + ", '^\\s*[\\[{]|[\\]}]\\s*,?\\s*$', '', 'g'), ','), "  # noqa: E731
                      f"lambda z: {js_trim_sql('z')}), lambda z: z <> '')")
    c["compose_e"] = (
        f"SELECT l.project, l.path, l.line, s.key AS service, p.key AS section, CASE WHEN l.line = l.pline THEN {inline} END AS value, unnest(CASE "
        f"WHEN l.line = l.pline THEN CASE WHEN regexp_matches({opened}, '^[\\[{{]') THEN {flow(inline)} ELSE [''] END "
        "WHEN l.item THEN [regexp_replace(l.body, '^-\\s*', '')] "
        f"WHEN regexp_matches({opened}, '^[\\[{{]') THEN {flow('l.body')} "
        f"WHEN l.key <> '' THEN [l.key || ': ' || CASE WHEN {inline} = '' THEN 'null' ELSE {inline} END] ELSE [''] END) AS part "
        "FROM compose_p l JOIN compose_l s ON s.project = l.project AND s.path = l.path AND s.line = l.sline "
        "JOIN compose_l p ON p.project = l.project AND p.path = l.path AND p.line = l.pline")
    c["compose_ports"] = (f"SELECT * FROM (SELECT *, {unq('part')} AS port FROM compose_e WHERE section = 'ports' AND part <> '') "
                          "WHERE (starts_with(port, '0.0.0.0:') OR NOT contains(port, ':')) AND NOT contains(port, '80:') AND NOT contains(port, '443:')")
    fk = q(G.FLOW_KEY)
    c["compose_envs"] = (f"SELECT * FROM (SELECT *, CASE WHEN regexp_matches(part, {fk}) THEN regexp_extract(part, {fk}, 1) || '=' || "
                         + unq(f"regexp_replace(part, {fk}, '')") + f" ELSE {unq('part')} END AS entry FROM compose_e WHERE section = 'environment' AND part <> '') "
                         f"WHERE {rx('entry', G.COMPOSE_ENV_SECRET)} AND NOT contains(entry, '${{')")
    c["compose_priv"] = "SELECT DISTINCT project, path, line, service FROM compose_e WHERE section = 'privileged' AND value IN ('true', 'True', 'TRUE')"
    c["iac_compose"] = " UNION ALL ".join([
        fnd("compose-privileged-container", "compose_priv",
            message="'Service ''' || service || ''' runs in privileged mode — full host access is granted'"),
        fnd("compose-port-exposure", "compose_ports",
            message="'Service ''' || service || ''' exposes port ' || port || ' on all interfaces (0.0.0.0)'"),
        fnd("compose-hardcoded-secret", "compose_envs",
            message="'Service ''' || service || ''' has hardcoded secret in environment variable'"),
    ])
    nl = "(SELECT * FROM cfg_lines WHERE kind = 'nextconfig')"
    near = ("len(list_filter(lines[greatest(line - 3, 1):line + 2], lambda l: contains(l, 'cors') OR "
            "contains(l, 'Access-Control') OR contains(l, 'headers'))) > 0")
    c["iac_next"] = " UNION ALL ".join([
        fnd("nextjs-cors-wildcard", f"{nl} WHERE (contains(text, '''*''') OR contains(text, '\"*\"')) AND {near}"),
        fnd("nextjs-public-secret", f"{nl} WHERE {rx('text', G.NEXT_PUBLIC_SECRET)}"),
        fnd("nextjs-dangerous-svg", f"{nl} WHERE contains(text, 'dangerouslyAllowSVG: true')"),
    ])
    vschema = '{"headers": [{"source": "VARCHAR", "headers": [{"key": "VARCHAR", "value": "VARCHAR"}]}]}'
    c["vercel_kv"] = (
        "SELECT project, path, unnest(hc.headers) AS kv FROM (SELECT project, path, unnest(j.headers) AS hc FROM "
        f"(SELECT project, path, CASE WHEN json_valid(content) THEN json_transform(content, {q(vschema)}) END AS j "
        "FROM cfg WHERE kind = 'vercel'))")
    c["iac_vercel"] = fnd("vercel-cors-wildcard",
                          "vercel_kv WHERE kv.key = 'Access-Control-Allow-Origin' AND kv.value = '*'", line="1")
    c["gitignore"] = (f"SELECT project, list_transform(string_split(content, chr(10)), lambda l: {js_trim_sql('l')}) AS gi_lines "
                      "FROM files WHERE path = '/.gitignore'")
    forms = "['.env', '*.env', '.env*', e.name, '/' || e.name]"
    c["iac_env"] = fnd(
        "env-not-gitignored",
        f"(SELECT e.* FROM (SELECT project, path, {_b()} AS name FROM cfg WHERE kind = 'dotenv') e "
        f"LEFT JOIN gitignore g ON e.project = g.project "
        f"WHERE NOT coalesce(list_has_any(g.gi_lines, {forms}), false))",
        line="1", message="name || ' is not listed in .gitignore — secrets may be committed to git'")
    c["config_findings"] = ("SELECT * FROM iac_docker UNION ALL SELECT * FROM iac_compose UNION ALL SELECT * FROM iac_next "
                            "UNION ALL SELECT * FROM iac_vercel UNION ALL SELECT * FROM iac_env")
    # ---- dependencies --------------------------------------------------
    mschema = '{"dependencies": "MAP(VARCHAR, VARCHAR)", "devDependencies": "MAP(VARCHAR, VARCHAR)"}'
    c["manifest"] = (f"SELECT project, CASE WHEN json_valid(content) THEN json_transform(content, {q(mschema)}) END AS m "
                     "FROM files WHERE path = '/package.json'")
    clean = "string_split(regexp_replace(spec, '^[\\^~>=<]', ''), ' ')[1]"
    c["npm_packages"] = (
        f"SELECT project, 'npm' AS ecosystem, name, {clean} AS version, is_dev, true AS is_direct FROM ("
        "SELECT project, unnest(map_keys(m.dependencies)) AS name, unnest(map_values(m.dependencies)) AS spec, false AS is_dev FROM manifest "
        "UNION ALL SELECT project, unnest(map_keys(m.devDependencies)), unnest(map_values(m.devDependencies)), true FROM manifest) "
        f"WHERE length({clean}) > 0 AND {clean} <> '*'")
    pt = js_trim_sql("raw")
    c["pypi_packages"] = (
        f"SELECT project, 'PyPI' AS ecosystem, regexp_extract(t, {q(D.PYPI_LINE)}, 1) AS name, "
        f"regexp_extract(t, {q(D.PYPI_LINE)}, 2) AS version, false AS is_dev, true AS is_direct FROM ("
        f"SELECT project, {pt} AS t FROM (SELECT project, unnest(string_split(content, chr(10))) AS raw FROM files "
        "WHERE path = '/requirements.txt')) "
        f"WHERE length(t) > 0 AND NOT starts_with(t, '#') AND NOT starts_with(t, '-') AND {rx('t', D.PYPI_LINE)}")
    c["packages"] = "SELECT * FROM npm_packages UNION ALL SELECT * FROM pypi_packages"
    c["deps_checked"] = ("SELECT project, sum(coalesce(cardinality(m.dependencies), 0) + coalesce(cardinality(m.devDependencies), 0))::BIGINT "
                         "AS dependencies_checked FROM manifest GROUP BY project")

    key = lambda v: version_key_sql(v, "a.pkg_ecosystem")
    c["adv_intervals"] = (
        "SELECT id, pkg_ecosystem, pkg_name, lo, hi, closed FROM ("
        "SELECT id, pkg_ecosystem, pkg_name, introduced AS lo, coalesce(fixed, last_affected, fixed2) AS hi, "
        "coalesce(fixed IS NULL AND last_affected IS NOT NULL, false) AS closed, introduced IS NOT NULL OR introduced2 IS NULL AS there FROM advisories_flat "
        "UNION ALL SELECT id, pkg_ecosystem, pkg_name, introduced2, fixed2, false, introduced2 IS NOT NULL FROM advisories_flat) WHERE there")
    c["adv_keys"] = (f"SELECT id, pkg_ecosystem, lower(pkg_name) AS name_lc, closed, {key('lo')} AS lo, {key('hi')} AS hi FROM adv_intervals a")
    c["sca_versions"] = (f"SELECT *, {version_key_sql('version', 'ecosystem')} AS vk FROM (SELECT DISTINCT ecosystem, name, version FROM packages)")
    c["sca_match"] = (
        "SELECT DISTINCT p.ecosystem, p.name, p.version, a.id AS adv_id FROM sca_versions p "
        "JOIN adv_keys a ON p.ecosystem = a.pkg_ecosystem AND lower(p.name) = a.name_lc "
        "WHERE (a.lo IS NULL OR p.vk >= a.lo) AND (a.hi IS NULL OR p.vk < a.hi OR (a.closed AND p.vk = a.hi)) "
        "UNION SELECT p.ecosystem, p.name, p.version, a.id FROM sca_versions p JOIN advisories_flat a "
        "ON p.ecosystem = a.pkg_ecosystem AND lower(p.name) = lower(a.pkg_name) AND p.version = a.extra_version")
    cvss = cvss_sql("a")
    fixed = "coalesce(a.fixed, a.fixed2)"
    lo, hi = "coalesce(a.introduced2, a.introduced)", "coalesce(a.fixed2, a.fixed)"
    rng = (f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN '>= ' || {lo} || ', < ' || {hi} "
           f"WHEN {lo} IS NOT NULL THEN '>= ' || {lo} WHEN {hi} IS NOT NULL THEN '< ' || {hi} ELSE '< *' END")
    expl = ("(a.ref_type = 'EVIDENCE' OR contains(a.ref_url, 'exploit') OR contains(a.ref_url, 'metasploit') "
            "OR contains(a.ref_url, 'packetstorm') OR contains(a.ref_url, 'exploit-db'))")
    cve = "coalesce(CASE WHEN starts_with(a.cve_alias, 'CVE-') THEN a.cve_alias END, a.id)"
    c["sca_joined"] = (
        f"SELECT k.project, k.name, k.version, k.is_dev, k.is_direct, a.id AS adv_id, a.summary, a.details, {cvss} AS cvss, "
        f"{fixed} AS fixed, {rng} AS rng, coalesce(a.cwe_id, 'CWE-1035') AS cwe, {cve} AS cve, {expl} AS expl "
        "FROM packages k JOIN sca_match m ON k.ecosystem = m.ecosystem AND k.name = m.name AND k.version = m.version "
        "JOIN advisories_flat a ON a.id = m.adv_id")
    sev = ("CASE WHEN cvss >= 9.0 THEN 'critical' WHEN cvss >= 7.0 THEN 'high' WHEN cvss >= 4.0 THEN 'medium' "
           "WHEN cvss >= 0.1 THEN 'low' ELSE 'info' END")
    present = {
        "id": "sha256(concat_ws('|', 'sca', project, '/package.json', '1', 'vulnerable-dependency', cve, name, version, adv_id))",
        "project": "project", "scanner": "'sca'", "rule": "'vulnerable-dependency'", "severity": sev,
        "confidence": "'high'", "path": "'/package.json'", "line": "1",
        "message": "name || '@' || version || ' has known vulnerability: ' || coalesce(nullif(summary, ''), adv_id)",
        "cwe": "cwe", "owasp": q(D.SCA_OWASP),
        "fix_suggestion": "CASE WHEN length(fixed) > 0 THEN 'Upgrade ' || name || ' to version ' || fixed || ' or later' "
                          "ELSE 'No fix available yet. Consider replacing ' || name || ' or adding mitigations' END",
        "package_name": "name", "installed_version": "version", "vulnerable_range": "rng", "fixed_version": "fixed",
        "cve": "cve", "cvss_score": "cvss",
        "description": "coalesce(nullif(details, ''), nullif(summary, ''), 'Vulnerability in ' || name)",
        "is_dev_dependency": "is_dev", "is_direct": "is_direct", "is_reachable": "NOT is_dev", "exploit_available": "expl",
    }
    c["sca_raw"] = f"SELECT {conform_sql(present)} FROM sca_joined"
    # ---- reachability --------------------------------------------------
    c["imp_src"] = (f"SELECT * FROM files WHERE {rx('path', r'\.(js|jsx|ts|tsx|mjs|cjs)$')} "
                    f"AND NOT {rx('path', _dirs(FS.IMPORT_IGNORE_DIRS))} AND NOT {rx('path', r'(^|/)\.')}")
    specs = " || ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in R.IMPORT_PATTERNS)
    norm = ("CASE WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[1:2], '/') "
            "ELSE string_split(spec, '/')[1] END")
    flags = "CASE " + " ".join(
        f"WHEN pkg = {q(k)} THEN {rx('content', '|'.join(f'(?:{p})' for p in v))}" for k, v in R.RISKY_FUNCTIONS.items()
    ) + " ELSE false END"
    c["imports"] = (f"SELECT DISTINCT project, pkg AS package, file, {flags} AS risky_used FROM ("
                    f"SELECT project, file, content, {norm} AS pkg FROM (SELECT project, path AS file, content, unnest({specs}) AS spec FROM imp_src))")
    risky = "[" + ", ".join(q(k) for k in R.RISKY_FUNCTIONS) + "]"
    c["pkg_usage"] = ("SELECT project, package AS package_name, count(*) AS n_imported, count(*) FILTER (WHERE risky_used) AS n_used, "
                      "list_sort(list(file)) AS imported_in, list_sort(list(file) FILTER (WHERE risky_used)) AS used_files, "
                      f"list_contains({risky}, package) AS has_patterns FROM imports GROUP BY project, package")
    dev = "coalesce(f.is_dev_dependency, false)"
    imported = "coalesce(u.n_imported, 0) > 0"
    used = "coalesce(u.n_used, 0) > 0"
    pat = f"coalesce(u.has_patterns, list_contains({risky}, f.package_name))"
    c["sca_reach"] = (
        f"SELECT f.*, CASE WHEN {dev} THEN false WHEN NOT {imported} THEN false WHEN {pat} AND NOT {used} THEN false ELSE true END AS reach_new, "
        f"CASE WHEN {dev} THEN {q(R.REASON_DEV)} WHEN NOT {imported} THEN 'Package ''' || f.package_name || ''' is not directly imported in any source file' "
        f"WHEN {pat} AND NOT {used} THEN 'Package ''' || f.package_name || ''' is imported but vulnerable functions are not called' "
        f"ELSE 'Package ''' || f.package_name || ''' is actively used in ' || CAST(CASE WHEN {pat} THEN u.n_used ELSE u.n_imported END AS VARCHAR) || ' file(s)' END AS reachability_reason, "
        f"CASE WHEN {dev} OR NOT {imported} THEN NULL WHEN {pat} AND {used} THEN u.used_files ELSE u.imported_in END AS used_in "
        "FROM sca_raw f LEFT JOIN pkg_usage u ON f.project = u.project AND f.package_name = u.package_name")
    cols = ", ".join(f'"{x}"' if x != "is_reachable" else "reach_new AS is_reachable" for x in O.FINDING_COLS)
    c["sca_findings"] = f"SELECT {cols} FROM sca_reach"
    # ---- scan ------------------------------------------------------------
    c["scan_raw"] = ("SELECT * FROM code_findings UNION ALL SELECT * FROM sca_findings UNION ALL "
                     "SELECT * FROM secret_findings UNION ALL SELECT * FROM config_findings")
    c.update(O.triage_ctes("scan_raw", "sc"))
    return c
