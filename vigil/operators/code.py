"""Code-pattern detection without a parser.

``spans.calls`` gives every call of a watched name with its callee, its arguments
split at their own commas, and where its expression begins, however many lines it
runs over; nothing inside comments, strings and templates counts as code. A rule
is a test of the callee and a test of the arguments, on the argument's text
(route, interpolations) or its *shape* (strings and parentheses emptied).

One row per (file, line, rule), the grain at which the reference dedups code
findings; of several the first by column stays. All rules are evaluated where
the file is read: neither its text nor its lines are copied for a call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import basename
from ..schemas import conform
from ..sources.files import code_files
from . import spans
from .lines import snippet_window

# ---------------------------------------------------------------------------
# Regex building blocks, valid in Java and RE2 alike
# ---------------------------------------------------------------------------
#: One step of a member chain.
STEP = r"(?:\s*!?\s*\.\s*[\w$]+|\s*!?\s*\[[^\[\]]*\])"
#: A member chain of any length, with calls (their parentheses emptied).
LINK = r"(?:\s*!?\s*\.\s*[\w$]+|\s*!?\s*\[[^\[\]]*\]|\s*\(\))"
INPUT_PROPERTY = r"(?:body|params|query|headers|cookies)"
#: A whole expression that is user input: a member of the request or its context, a variable of such a name,
#: or (``IS_CHAIN`` and ``ENDS_IN_INPUT``) anything's body, params, ...
IS_INPUT_NAME = (r"^(?:(?:req|request)" + STEP + "{1,2}|(?:ctx|context)" + STEP
                 + r"|(?i:input|data|payload|params|body|query))$")
IS_CHAIN = r"^(?:[\w$]+|\(\))(?:" + LINK + r")*+$"
ENDS_IN_INPUT = r"(?:\.\s*" + INPUT_PROPERTY + r"|\[\s*" + INPUT_PROPERTY + r"\s*\])$"
ENDS_IN_PARAMS = r"(?:\.\s*params|\[\s*params\s*\])" + STEP + "{0,3}$"
LAST_STEP = STEP + "$"
INTERPOLATION = r"\$\{([^{}]*)\}"
IS_TEMPLATE, IS_STRING = "^``$", """^(?:''|"")$"""
#: A binary expression: an operator between operands, no lower one outside of parentheses.
BINARY = r"""[\w$)\]'"`}]\s*(?:\+|-|\*|/|%|<|>|[=!]==?|\binstanceof\b|\bin\b)\s*[\w$(\['"`{.+!~-]"""
LOWER = r"&&|\|\||\?|=>|(?:^|[^=!<>])=(?:[^=>]|$)"

# Fixed values that must equal the reference's for right results.
AUTH_MIDDLEWARE = ["auth", "authenticate", "requireAuth", "isAuthenticated", "verifyToken",
                   "checkAuth", "authMiddleware", "protect", "ensureAuth", "jwtMiddleware"]
SENSITIVE_ROUTE = r"/(admin|user|account|profile|payment|order|secret|private|api/v\d)"
CRED_WORDS_ASSIGN = ["password", "passwd", "secret", "apikey", "api_key", "token", "accesstoken",
                     "access_token", "privatekey", "private_key", "authtoken"]
CRED_WORDS_DECL = CRED_WORDS_ASSIGN + ["jwtsecret", "jwt_secret"]
# Placeholder words of the two credential rules (the empty-string marker,
# which makes both rules unreachable as written, is left out: intent).
CRED_PLACEHOLDERS_ASSIGN = ["xxx", "placeholder", "changeme", "your-secret", "your_secret", "example"]
CRED_PLACEHOLDERS_DECL = ["xxx", "placeholder", "changeme", "your-secret", "example", "test", "development"]

A03 = "A03:2021 – Injection"
A01 = "A01:2021 – Broken Access Control"
A07 = "A07:2021 – Identification and Authentication Failures"
A08 = "A08:2021 – Software and Data Integrity Failures"


@dataclass(frozen=True)
class CodeRule:
    key: str            # operator key (one per detection branch)
    rule: str           # reported rule id
    severity: str
    confidence: str
    cwe: str
    owasp: str
    message: str        # {method}, {route}, {name}: taken from the call
    fix: str
    callee: str         # pattern of the callee, or of the variable's name
    ref_dead: bool = False


# Messages, fixes and classification of each rule.
CODE_RULES = [
    CodeRule("sast_sql_raw_unsafe", "sql-injection-raw-unsafe", "critical", "high", "CWE-89", A03,
             "SQL injection via Prisma $queryRawUnsafe with dynamic query construction",
             "Use $queryRaw with tagged template literals or parameterized queries: prisma.$queryRaw`SELECT * FROM users WHERE id = ${id}`",
             r"\.\$queryRawUnsafe$"),
    CodeRule("sast_sql_template", "sql-injection-template-literal", "critical", "high", "CWE-89", A03,
             "SQL injection via template literal interpolation in database query",
             'Use parameterized queries: db.query("SELECT * FROM users WHERE id = ?", [userId])',
             r"\.query$"),
    CodeRule("sast_cmd_member", "command-injection", "critical", "high", "CWE-78", A03,
             "Command injection via child_process.{method} with user-controlled input",
             "Use execFile with an array of arguments instead of string interpolation, or use a whitelist of allowed commands",
             r"\.(exec|execSync|execFile|execFileSync|spawn|spawnSync)$"),
    CodeRule("sast_cmd_bare", "command-injection", "critical", "high", "CWE-78", A03,
             "Command injection via exec() with user-controlled input",
             "Use execFile with an array of arguments, or sanitize input with a strict allowlist",
             r"^(?:exec|execSync)$"),
    CodeRule("sast_eval", "unsafe-eval", "critical", "high", "CWE-94", A03,
             "Use of eval() with dynamic content allows arbitrary code execution",
             "Avoid eval() entirely. Use JSON.parse() for data, or specific APIs for dynamic behavior",
             r"^eval$"),
    CodeRule("sast_function_ctor", "function-constructor-injection", "high", "medium", "CWE-94", A03,
             "Dynamic Function() constructor can execute arbitrary code",
             "Avoid the Function constructor with dynamic arguments. Refactor to use explicit function declarations",
             r"^new Function$", ref_dead=True),
    CodeRule("sast_path_traversal", "path-traversal", "high", "high", "CWE-22", A01,
             "Path traversal vulnerability: file system access with user-controlled path",
             "Validate and sanitize file paths. Use path.resolve() and verify the result starts with an allowed base directory",
             r"^fs\.(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream)$"),
    CodeRule("sast_nosql", "nosql-injection", "high", "medium", "CWE-943", A03,
             "NoSQL injection: MongoDB query built directly from user input without sanitization",
             "Sanitize query inputs. Use a schema validation library (e.g., Zod) and only extract expected fields from user input",
             r"\.(?:find|findOne|findById|where|update|updateOne|deleteOne|remove)$"),
    CodeRule("sast_idor", "idor", "high", "medium", "CWE-639", A01,
             "IDOR: Database query using req.params.id without ownership verification",
             "Verify the authenticated user owns the requested resource before returning data",
             r"\.(?:findById|findOne|find)$"),
    CodeRule("sast_proto_pollution", "prototype-pollution", "high", "medium", "CWE-1321", A08,
             "Prototype pollution: Object.assign() with external user input may pollute Object prototype",
             "Use Object.create(null) for safe merge targets, or validate input with a schema before merging",
             r"^Object\.assign$"),
    CodeRule("sast_missing_auth", "missing-auth-middleware", "high", "medium", "CWE-306", A07,
             "Sensitive route '{route}' lacks authentication middleware",
             "Add authentication middleware: app.{method}('{route}', authenticate, handler)",
             r"^(?:app|router|api)\.(get|post|put|delete|patch)$"),
    CodeRule("sast_xss_inner_html", "xss-dangerous-inner-html", "high", "high", "CWE-79", A03,
             "XSS vulnerability: dangerouslySetInnerHTML used without sanitization",
             "Sanitize HTML content using DOMPurify before setting innerHTML: dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(content) }}",
             r"^dangerouslySetInnerHTML$"),
    CodeRule("sast_hardcoded_assign", "hardcoded-credentials", "high", "high", "CWE-798", A07,
             "Hardcoded credential detected in variable '{name}'",
             "Move secrets to environment variables: process.env.SECRET_KEY",
             r"([\w$]+(?:\s*\.\s*[\w$]+)*)\s*=\s*$", ref_dead=True),
    CodeRule("sast_hardcoded_decl", "hardcoded-credentials", "high", "high", "CWE-798", A07,
             "Hardcoded credential detected in variable '{name}'",
             "Move secrets to environment variables and use process.env.SECRET_KEY",
             r"([\w$]+)(?:\s*:\s*[\w$<>\[\]|. ]+)?\s*=\s*$", ref_dead=True),

]
RULES_BY_KEY = {r.key: r for r in CODE_RULES}


def is_test_file_code(path: Column) -> Column:
    """.test/.spec basename, or __tests__ / __mocks__ anywhere in the path."""
    return (basename(path).rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)\z")
            | F.contains(path, F.lit("__tests__")) | F.contains(path, F.lit("__mocks__")))


#: What may stand before the bracket of a watched call; other brackets only bound arguments.
WATCHED = (r"(?:(?:queryRawUnsafe|query|exec|execSync|execFile|execFileSync|spawn|spawnSync|eval|Function|readFile|readFileSync"
           r"|writeFile|writeFileSync|createReadStream|createWriteStream|find|findOne|findById|where|update|updateOne|deleteOne"
           r"|remove|assign|get|post|put|delete|patch)\s*(?:<[^<>()]*>)?|dangerouslySetInnerHTML\s*=)\s*$")
#: A file without any of these has no watched call.
CALLEE_TOKENS = ["query", "exec", "spawn", "eval", "Function", "fs", "find", "where", "update", "deleteOne", "remove", "assign",
                 "app", "router", "api", "dangerouslySetInnerHTML"]
#: The code before a method's or a function's name where it is declared, not called.
DECLARES = r"\b(?:function|get|set|static|async)\s*\*?\s*$"
DECLARED = r"\b(?:const|let|var)\s+$"
IN_DECLARATION = r"\b(?:const|let|var)\s"
#: After a call's bracket: a body, so it was a declaration. After a string: the expression goes on.
OPENS_BODY, CONTINUES = r"^\s*(?::[^=;]*)?\{$", r"^\s*[.+*/%?&|=<>\[(-]"
#: Before an assignment's target: a statement begins.
BEGINS = r"(?:^|[;\n>])[ \t]*$"
PATH_JOIN = r"^[\w$.]+\.\s*(?:join|resolve)\s*\(((?s:.)*)\)$"
MIDDLEWARE = r"^(?:[\w$]+(?:\s*\([^()]*\))?\s*\.\s*)*+([\w$]+)$"
HTML_VALUE = r"""^\{\s*(?:[^{}]*?,)?\s*__html\s*:\s*(''\s*[,}]|""\s*[,}]|[^\s,}])"""
HTML_STRING = """^(''|"")"""


def _arg(c: Column, i: int) -> Column:
    return F.coalesce(F.get(c["args"], i), F.lit(""))


def input_shape(shape: Column) -> Column:
    return shape.rlike(IS_INPUT_NAME) | (shape.rlike(IS_CHAIN) & shape.rlike(ENDS_IN_INPUT))


def user_input(arg: Column) -> Column:
    return let(spans.shape(arg), input_shape)


def input_template(arg: Column) -> Column:
    """A template with an interpolation that is user input or a member of it."""
    return spans.shape(arg).rlike(IS_TEMPLATE) & F.exists(
        F.regexp_extract_all(arg, F.lit(INTERPOLATION), F.lit(1)), lambda e: let(
            spans.trimmed(spans.shape(e)), lambda s: input_shape(s) | input_shape(F.regexp_replace(s, LAST_STEP, ""))))


def binary(arg: Column) -> Column:
    return let(F.regexp_replace(F.regexp_replace(spans.shape(arg), r"\{[^{}]*\}", "{}"), r"\[[^\[\]]*\]", "[]"),
               lambda s: s.rlike(BINARY) & ~s.rlike(LOWER))


def string_value(arg: Column) -> Column:
    """What a string literal says; null for any other expression."""
    return F.when(spans.shape(arg).rlike(IS_STRING), F.substring(arg, F.lit(2), F.length(arg) - 2))


def _path_argument(arg: Column) -> Column:
    """User input itself, or among the arguments of a join or resolve."""
    inner = F.regexp_extract(arg, PATH_JOIN, 1)
    return user_input(arg) | input_template(arg) | F.exists(spans.parts(spans.shape(inner)), input_shape)


def _has_auth(c: Column) -> Column:
    """Among the arguments between route and handler is a name, or a member, that authenticates."""
    middle = F.slice(c["args"], F.lit(2), F.greatest(F.size(c["args"]) - 2, F.lit(0)))
    return F.exists(middle, lambda a: F.regexp_extract(a, MIDDLEWARE, 1).isin(AUTH_MIDDLEWARE))


def _dynamic_html(arg: Column) -> Column:
    """An expression, or an object whose __html is no string."""
    value = F.regexp_extract(spans.shape(arg), HTML_VALUE, 1)
    return F.when(spans.shape(arg).startswith("{"), (value != "") & ~value.rlike(HTML_STRING)).otherwise(~arg.isin("", "null"))


#: Tests of the arguments of a call whose callee matches.
ARGUMENTS: dict[str, Callable[[Column, Column], Column]] = {
    "sast_sql_raw_unsafe": lambda c, path: spans.shape(_arg(c, 0)).rlike(IS_TEMPLATE) | binary(_arg(c, 0)),
    "sast_sql_template": lambda c, path: input_template(_arg(c, 0)),
    "sast_cmd_member": lambda c, path: input_template(_arg(c, 0)) | user_input(_arg(c, 0)) | binary(_arg(c, 0)),
    "sast_cmd_bare": lambda c, path: input_template(_arg(c, 0)) | user_input(_arg(c, 0)),
    "sast_eval": lambda c, path: (F.size(c["args"]) > 0) & ~spans.shape(_arg(c, 0)).rlike(IS_STRING),
    "sast_function_ctor": lambda c, path: F.exists(c["args"], lambda a: ~spans.shape(a).rlike(IS_STRING)),
    "sast_path_traversal": lambda c, path: _path_argument(_arg(c, 0)),
    "sast_nosql": lambda c, path: user_input(_arg(c, 0)),
    "sast_idor": lambda c, path: let(spans.shape(_arg(c, 0)), lambda s: s.rlike(IS_CHAIN) & s.rlike(ENDS_IN_PARAMS)),
    "sast_proto_pollution": lambda c, path: F.exists(F.slice(c["args"], F.lit(2), F.greatest(F.size(c["args"]) - 1, F.lit(0))), user_input),
    "sast_missing_auth": lambda c, path: (F.size(c["args"]) >= 2) & F.coalesce(string_value(_arg(c, 0)), F.lit("")).rlike(SENSITIVE_ROUTE)
    & ~_has_auth(c) & ~is_test_file_code(path),
    "sast_xss_inner_html": lambda c, path: _dynamic_html(_arg(c, 0)),
}


def _fires(rule: CodeRule, c: Column, path: Column) -> Column:
    called = c["callee"].rlike(rule.callee)
    if rule.key == "sast_xss_inner_html":
        called = called & (c["opened"] == "{")
    else:
        called = called & (c["opened"] == "(") & ~c["callee"].startswith("?")
        if rule.key != "sast_function_ctor":
            called = called & ~c["callee"].startswith("new ")
        if rule.key in ("sast_cmd_bare", "sast_eval"):
            called = called & ~c["prefix"].rlike(DECLARES) & ~c["after"].rlike(OPENS_BODY)
    return called & ARGUMENTS[rule.key](c, path)


def _texts(rule: CodeRule, c: Column) -> tuple[Column, Column]:
    """Message and fix, with what they name of the call filled in."""
    method = F.regexp_extract(c["callee"], rule.callee, 1) if "(" in rule.callee.replace("(?:", "") else F.lit("")
    route = F.coalesce(string_value(_arg(c, 0)), F.lit(""))

    def fill(text: str) -> Column:
        out: Column = F.lit(text)
        for name, value in (("{method}", method), ("{route}", route)):
            if name in text:
                out = F.replace(out, F.lit(name), value)
        return out

    return fill(rule.message), fill(rule.fix)


def _hit(rule: CodeRule, c: Column, message: Column, fix: Column, lines: Column) -> Column:
    return F.struct(c["line"].alias("line"), F.lit(rule.rule).alias("rule"), c["column"].alias("column"),
                    F.lit([r.key for r in CODE_RULES].index(rule.key)).alias("nr"), F.lit(rule.key).alias("key"), message.alias("message"),
                    fix.alias("fix_suggestion"), snippet_window(lines, c["line"]).alias("snippet"))


def _call_hits(path: Column, lines: Column, rules: list[CodeRule]) -> Column:
    def of(c: Column) -> Column:
        return F.filter(F.array(*(F.when(_fires(r, c, path), _hit(r, c, *_texts(r, c), lines)) for r in rules)), lambda h: h.isNotNull())

    return F.flatten(F.transform("#calls", of))


def _credential_hits(lines: Column, rule: CodeRule) -> Column:
    """Strings given to a variable, or a member, whose name says credential."""
    declared = rule.key == "sast_hardcoded_decl"
    words, placeholders = ((CRED_WORDS_DECL, CRED_PLACEHOLDERS_DECL) if declared else (CRED_WORDS_ASSIGN, CRED_PLACEHOLDERS_ASSIGN))

    def fires(s: Column) -> Column:
        name, value = F.lower(F.regexp_extract(s["name"], r"[\w$]+$", 0)), F.lower(s["value"])
        ends = ~s["after"].rlike(CONTINUES)
        where = s["prefix"].rlike(DECLARED) if declared else (
            ~s["prefix"].rlike(IN_DECLARATION) & s["prefix"].rlike(BEGINS) & ~s["before"].isin("(", ","))
        return (where & ends & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
                & (F.length(s["value"]) > 4) & ~F.exists(F.array(*map(F.lit, placeholders)), lambda w: F.contains(value, w)))

    def hit(s: Column) -> Column:
        own = F.regexp_extract(s["name"], r"[\w$]+$", 0)
        message = F.replace(F.lit(rule.message), F.lit("{name}"), own if declared else F.lower(own))
        return _hit(rule, s, message, F.lit(rule.fix), lines)

    return F.transform(F.filter("#strings", fires), hit)


def code_hits(files: DataFrame, include_ref_dead: bool = False, rules=None) -> DataFrame:
    """One row per (project, path, line, rule) that fires."""
    rules = [r for r in (rules or CODE_RULES) if include_ref_dead or not r.ref_dead]
    called = [r for r in rules if r.key in ARGUMENTS]
    given = [r for r in rules if r.key not in ARGUMENTS]
    content, path = F.col("content"), F.col("path")
    some = F.lit(bool(given)) & content.rlike(r"=\s*['\"]")
    for token in CALLEE_TOKENS if called else []:
        some = some | F.contains(content, F.lit(token))

    def first(hits: Column) -> Column:
        """Of hits on one line by one rule the first by column, then in the order of the rules."""
        return F.filter(hits, lambda h, i: (i == 0) | F.coalesce(F.get(hits, i - 1)["line"] != h["line"], F.lit(True))
                        | F.coalesce(F.get(hits, i - 1)["rule"] != h["rule"], F.lit(True)))

    found = spans.with_units(code_files(files).where(some).select("project", "path", "content"))
    hits = []
    if called:
        found, hits = spans.with_calls(found, WATCHED), [let(F.col("#lines"), lambda lines: _call_hits(path, lines, called))]
    for r in given:
        found = spans.with_strings(found, r.callee).withColumn(f"#{r.key}", let(F.split(content, "\n", -1), (lambda rule: lambda lines: _credential_hits(lines, rule))(r))).drop("#strings")
        hits.append(F.col(f"#{r.key}"))
    found = found.withColumn("#lines", F.split(content, "\n", -1)).withColumn("#hits", F.array_sort(F.concat(*hits)))
    return found.select("project", "path", F.explode(first(F.col("#hits"))).alias("h")).select("project", "path", "h.*")


def code_findings(files: DataFrame, include_ref_dead: bool = False, rules=None) -> DataFrame:
    h = code_hits(files, include_ref_dead, rules)
    meta = {r.key: r for r in CODE_RULES}
    attr = lambda a: F.element_at(F.create_map(*[x for k, r in meta.items() for x in (F.lit(k), F.lit(getattr(r, a)))]), F.col("key"))
    out = h.select(
        F.sha2(F.concat_ws("|", F.lit("sast"), "project", "path", F.col("line").cast("string"), "rule", F.lit("")), 256).alias("id"),
        "project", F.lit("sast").alias("scanner"), "rule", attr("severity").alias("severity"),
        attr("confidence").alias("confidence"), "path", "line", "column", "message",
        attr("cwe").alias("cwe"), attr("owasp").alias("owasp"),
        "snippet", "fix_suggestion")
    return conform(out)
