"""Configuration checks: Dockerfile, docker-compose, Next config, vercel.json,
.env files not covered by the root .gitignore.

* Dockerfile / Next config: per-line predicates on exploded lines; the
  Next CORS look-around (lines i-3..i+2) is an array slice: no shuffle.
* Dockerfile "no non-root USER": one ``bool_or``-style aggregate per file.
* docker-compose: no YAML parser; each line's service and section are
  carried forward with ``last(..., ignorenulls)`` over a per-file window
  (only compose files are shuffled, by file). Block style with two-space
  indentation; reported line is the line that holds the value.
* vercel.json: ``from_json`` with a nested schema, exploded twice.
* .env vs .gitignore: an equi-join on project to the root .gitignore row,
  then an array predicate on its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.text import basename, js_trim
from ..schemas import conform
from ..sources.files import config_files, root_file
from .lines import lines_explode

# Fixed values that must equal the reference's for right results.
OWASP_A05 = "A05:2021 – Security Misconfiguration"
IAC = {
    "dockerfile-root-user": ("high", "high", "CWE-250",
                             "Dockerfile explicitly sets USER to root, running containers as root is a security risk",
                             "Create a non-root user: RUN adduser --disabled-password appuser && USER appuser"),
    "dockerfile-latest-tag": ("medium", "high", "CWE-1104", None,
                              "Pin to a specific version digest: FROM node:20.11-alpine3.19@sha256:..."),
    "dockerfile-secret-in-env": ("critical", "high", "CWE-798",
                                 "Dockerfile hardcodes a secret in an ENV instruction — it will be exposed in image layers and metadata",
                                 "Use Docker BuildKit secrets or runtime environment injection instead of hardcoding in ENV"),
    "dockerfile-copy-env": ("critical", "high", "CWE-798",
                            "Dockerfile copies .env file into image — secrets will be embedded in the image layer",
                            "Remove COPY .env from Dockerfile. Use Docker secrets or environment variables at runtime"),
    "dockerfile-insecure-download": ("medium", "high", "CWE-829",
                                     "Dockerfile downloads over HTTP (not HTTPS), vulnerable to MITM attacks",
                                     "Use HTTPS URLs for all downloads and verify checksums"),
    "dockerfile-no-user": ("high", "high", "CWE-250",
                           "Dockerfile does not specify a non-root USER — container runs as root by default",
                           "Add a non-root user: RUN addgroup -S appgroup && adduser -S appuser -G appgroup && USER appuser"),
    "compose-privileged-container": ("critical", "high", "CWE-250", None,
                                     "Remove privileged: true. Use specific Linux capabilities instead: cap_add: [NET_ADMIN]"),
    "compose-port-exposure": ("medium", "medium", "CWE-16", None,
                              'Bind to specific interface: "127.0.0.1:5432:5432" to limit exposure'),
    "compose-hardcoded-secret": ("high", "high", "CWE-798", None,
                                 "Use Docker secrets or reference .env file with variable substitution: POSTGRES_PASSWORD=${POSTGRES_PASSWORD}"),
    "nextjs-cors-wildcard": ("medium", "high", "CWE-942",
                             "Next.js config uses CORS wildcard (*) allowing requests from any origin",
                             "Restrict CORS to specific trusted origins instead of using wildcard"),
    "nextjs-public-secret": ("high", "high", "CWE-312",
                             "Secret/sensitive value exposed as NEXT_PUBLIC_ env var — visible in client-side bundle",
                             "Never prefix secrets with NEXT_PUBLIC_. Only public values (like API endpoints) should use this prefix"),
    "nextjs-dangerous-svg": ("medium", "high", "CWE-79",
                             "Next.js Image component has dangerouslyAllowSVG enabled which can lead to XSS",
                             "Add contentSecurityPolicy option when enabling dangerouslyAllowSVG"),
    "vercel-cors-wildcard": ("medium", "high", "CWE-942",
                             "vercel.json sets CORS Access-Control-Allow-Origin to wildcard (*)",
                             "Replace * with specific allowed origins"),
    "env-not-gitignored": ("critical", "high", "CWE-312", None,
                           "Add .env to .gitignore immediately. Rotate any secrets that may have been exposed. Use .env.example for templates."),
}
DOCKER_ENV_SECRET = r"(?i)(password|secret|key|token|api_key|apikey|auth)\s*[=\s]+\S+"
COMPOSE_ENV_SECRET = r"(?i)(PASSWORD|SECRET|KEY|TOKEN|API_KEY)\s*=\s*\S+"
NEXT_PUBLIC_SECRET = r"(?i)NEXT_PUBLIC_.*(?:SECRET|KEY|TOKEN|PASSWORD)"
CORS_CONTEXT = ["cors", "Access-Control", "headers"]
GITIGNORE_ENV_FORMS = [".env", "*.env", ".env*"]  # plus '<name>' and '/<name>'

VERCEL_SCHEMA = T.StructType([T.StructField("headers", T.ArrayType(T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
])))])


HIT = "struct<rule:string,line:int,message:string>"


def _hit(rule: str, line: Column, message: Column | None = None) -> Column:
    """What a rule reports: its line, and its message where that names what was found."""
    return F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line"),
                    (message if message is not None else F.lit(None).cast("string")).alias("message")).cast(HIT)


def _fired(*hits: Column) -> Column:
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def _findings(df: DataFrame, hits: Column) -> DataFrame:
    """A row for each of a row's hits, with what is fixed for their rules."""
    fixed = F.create_map(*[x for rule, values in IAC.items() for x in (
        F.lit(rule), F.struct(*(F.lit(v).alias(n) for n, v in zip(("severity", "confidence", "cwe", "message", "fix"), values, strict=True))))])
    rows = df.select("project", "path", F.explode(hits).alias("h")).withColumn("f", F.element_at(fixed, F.col("h.rule")))
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("iac"), "project", "path", F.col("h.line").cast("string"), "h.rule", F.lit("")), 256).alias("id"),
        "project", F.lit("iac").alias("scanner"), F.col("h.rule").alias("rule"), F.col("f.severity").alias("severity"),
        F.col("f.confidence").alias("confidence"), "path", F.col("h.line").alias("line"),
        F.coalesce("h.message", "f.message").alias("message"),
        F.col("f.cwe").alias("cwe"), F.lit(OWASP_A05).alias("owasp"), F.col("f.fix").alias("fix_suggestion"),
        basename(F.col("path")).alias("config_file"))


# ---------------------------------------------------------------------------
# Dockerfile
# ---------------------------------------------------------------------------

def _user_part(text: Column) -> Column:
    return F.lower(js_trim(F.substring(js_trim(text), 6, 1 << 30)))


def _is_user_line(text: Column) -> Column:
    return F.upper(js_trim(text)).startswith("USER ")


def dockerfile_hits(lines: Column) -> Column:
    """Rules on each line, and on the whole file: no USER line that names a non-root user."""
    def of(t: Column, i: Column) -> Column:
        image, n = F.regexp_extract(t, r"(?i)^FROM\s+(\S+)", 1), i + 1
        unstable = F.contains(image, F.lit(":latest")) | (~F.contains(image, F.lit(":")) & ~image.startswith("scratch"))
        return _fired(
            F.when(_is_user_line(t) & _user_part(t).isin("root", "0"), _hit("dockerfile-root-user", n)),
            F.when(t.rlike(r"(?i)^FROM\s+\S") & unstable, _hit("dockerfile-latest-tag", n, F.concat(
                F.lit("Dockerfile uses unstable image tag '"), image, F.lit("'. Using :latest or no tag is not reproducible")))),
            F.when(t.rlike(r"(?i)^ENV\s+.") & F.regexp_extract(t, r"(?i)^ENV\s+(.+)", 1).rlike(DOCKER_ENV_SECRET),
                   _hit("dockerfile-secret-in-env", n)),
            F.when(js_trim(t).rlike(r"^COPY\s+.*\.env"), _hit("dockerfile-copy-env", n)),
            F.when(t.rlike(r"(?i)RUN.*(wget|curl).*http://"), _hit("dockerfile-insecure-download", n)))

    named = F.exists(lines, lambda t: _is_user_line(t) & ~_user_part(t).isin("root", "0"))
    return F.concat(F.flatten(F.transform(lines, of)), _fired(F.when(~named, _hit("dockerfile-no-user", F.lit(1)))))


# ---------------------------------------------------------------------------
# docker-compose
# ---------------------------------------------------------------------------

#: A comment behind a value, outside of quotes; a key at a line's start; a key inside a flow map.
YAML_COMMENT = r"""^([^"'\s]*+(?:(?:\s*+"[^"]*+"|\s*+'[^']*+'|\s++[^#\s"'])[^"'\s]*+)*+)\s+#.*$"""
YAML_KEY = r"""^["']?([A-Za-z0-9_.\-]+)["']?\s*:(?:\s|$)"""
FLOW_KEY = r"""^["']?([A-Za-z0-9_.\-]+)["']?\s*:\s+"""


def _unquote(x: Column) -> Column:
    return F.regexp_replace(js_trim(x), r"""^(['"])(.*)\1\z""", "$2")


def _flow_parts(x: Column) -> Column:
    """The parts of a flow list or map, or of one of its lines."""
    parts = F.transform(F.split(F.regexp_replace(x, r"^\s*[\[{]|[\]}]\s*,?\s*$", ""), ","), js_trim)
    return F.filter(parts, lambda p: p != "")


def compose_entries(cfg: DataFrame) -> DataFrame:
    """(project, path, line, service, section, value, parts): every line that gives a service's property a value, with the
    entries it holds; value is what stands on the property's own line.

    No width of indentation is assumed. Each block takes its own from the file: services stand at the least indent under
    ``services``, a service's properties at the least indent under it; what is deeper, or a list item at a property's own
    indent, belongs to the property. Lists and maps may be in flow style, over several lines too."""
    lines = lines_explode(cfg.where(F.col("kind") == "compose"))
    t = F.col("text")
    body = js_trim(t)
    indent = F.length(t) - F.length(F.regexp_replace(t, r"^\s+", ""))
    lines = lines.select("project", "path", "line", body.alias("body"), indent.alias("indent")).where(
        (F.length("body") > 0) & ~F.col("body").startswith("#"))
    lines = lines.withColumn("body", F.regexp_replace("body", YAML_COMMENT, "$1"))
    item = F.col("body").rlike(r"^-(\s|$)")
    lines = lines.withColumn("item", item).withColumn("key", F.when(item, F.lit("")).otherwise(F.regexp_extract("body", YAML_KEY, 1)))
    file = Window.partitionBy("project", "path")
    so_far = file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.col("key") != ""
    lines = lines.withColumn("top", F.last(F.when((F.col("indent") == 0) & named, F.col("key")), ignorenulls=True).over(so_far))
    inside = (F.col("top") == "services") & (F.col("indent") > 0)
    lines = lines.withColumn("service_indent", F.min(F.when(inside, F.col("indent"))).over(file)).where(inside)
    begins = (F.col("indent") == F.col("service_indent")) & named
    lines = lines.withColumn("nr", F.sum(begins.cast("int")).over(so_far)).withColumn(
        "service", F.last(F.when(begins, F.col("key")), ignorenulls=True).over(so_far))
    own = Window.partitionBy("project", "path", "nr")
    lines = lines.withColumn("own_indent", F.min(F.when(F.col("indent") > F.col("service_indent"), F.col("indent"))).over(own))
    lines = lines.where((F.col("nr") > 0) & (F.col("indent") > F.col("service_indent")))
    is_property = (F.col("indent") == F.col("own_indent")) & named
    inline = js_trim(F.regexp_replace("body", YAML_KEY, ""))
    head = F.last(F.when(is_property, F.struct(F.col("key").alias("section"), inline.alias("opened"))), ignorenulls=True).over(
        own.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("head", head).withColumn("own_line", is_property).withColumn("inline", inline)
    flows = F.col("head.opened").rlike(r"^[\[{]")
    parts = (F.when(F.col("own_line"), F.when(flows, _flow_parts(F.col("inline"))).otherwise(F.array().cast("array<string>")))
             .when(F.col("item"), F.array(F.regexp_replace("body", r"^-\s*", "")))
             .when(flows, _flow_parts(F.col("body")))
             .when(named, F.array(F.concat("key", F.lit(": "), F.when(inline == "", F.lit("null")).otherwise(inline))))
             .otherwise(F.array().cast("array<string>")))
    return lines.select("project", "path", "line", "service", F.col("head.section").alias("section"),
                        F.when(F.col("own_line"), F.col("inline")).alias("value"), parts.alias("parts"))


def compose_findings(cfg: DataFrame) -> DataFrame:
    section, svc, line = F.col("section"), F.col("service"), F.col("line")
    privileged = F.when((section == "privileged") & F.col("value").isin("true", "True", "TRUE"), _hit(
        "compose-privileged-container", line,
        F.concat(F.lit("Service '"), svc, F.lit("' runs in privileged mode — full host access is granted"))))

    def port(part: Column) -> Column:
        p = _unquote(part)
        exposed = ((p.startswith("0.0.0.0:") | ~F.contains(p, F.lit(":"))) & ~F.contains(p, F.lit("80:")) & ~F.contains(p, F.lit("443:")))
        return F.when((section == "ports") & exposed, _hit("compose-port-exposure", line, F.concat(
            F.lit("Service '"), svc, F.lit("' exposes port "), p, F.lit(" on all interfaces (0.0.0.0)"))))

    def variable(part: Column) -> Column:
        entry = F.when(part.rlike(FLOW_KEY), F.concat(
            F.regexp_extract(part, FLOW_KEY, 1), F.lit("="), _unquote(F.regexp_replace(part, FLOW_KEY, "")))).otherwise(_unquote(part))
        return F.when((section == "environment") & entry.rlike(COMPOSE_ENV_SECRET) & ~F.contains(entry, F.lit("${")), _hit(
            "compose-hardcoded-secret", line, F.concat(F.lit("Service '"), svc, F.lit("' has hardcoded secret in environment variable"))))

    each = F.flatten(F.transform("parts", lambda p: _fired(port(p), variable(p))))
    return _findings(compose_entries(cfg), F.concat(_fired(privileged), each))


# ---------------------------------------------------------------------------
# Next config, vercel.json, .env
# ---------------------------------------------------------------------------

def next_config_hits(lines: Column) -> Column:
    def of(t: Column, i: Column) -> Column:
        context = F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i + 3, F.size(lines)) - F.greatest(i - 2, F.lit(1)) + 1)
        near = F.exists(context, lambda l: F.contains(l, F.lit(CORS_CONTEXT[0])) | F.contains(l, F.lit(CORS_CONTEXT[1]))
                        | F.contains(l, F.lit(CORS_CONTEXT[2])))
        star = F.contains(t, F.lit("'*'")) | F.contains(t, F.lit('"*"'))
        return _fired(F.when(star & near, _hit("nextjs-cors-wildcard", i + 1)),
                      F.when(t.rlike(NEXT_PUBLIC_SECRET), _hit("nextjs-public-secret", i + 1)),
                      F.when(F.contains(t, F.lit("dangerouslyAllowSVG: true")), _hit("nextjs-dangerous-svg", i + 1)))

    return F.flatten(F.transform(lines, of))


def vercel_hits(content: Column) -> Column:
    """A hit for each header that lets all origins in."""
    entries = F.filter(F.coalesce(F.from_json(content, VERCEL_SCHEMA)["headers"], F.array()), lambda e: e["headers"].isNotNull())
    headers = F.flatten(F.transform(entries, lambda e: e["headers"]))
    wild = F.filter(headers, lambda h: (h["key"] == "Access-Control-Allow-Origin") & (h["value"] == "*"))
    return F.transform(wild, lambda h: _hit("vercel-cors-wildcard", F.lit(1)))


def file_findings(cfg: DataFrame) -> DataFrame:
    """The rules that need one file only, all in one pass over the files, which are not cut into rows."""
    kind, content = F.col("kind"), F.col("content")
    rows = cfg.where(kind.isin("dockerfile", "nextconfig", "vercel")).withColumn("lines", F.split(content, "\n", -1))
    hits = let(F.col("lines"), lambda lines: F.when(kind == "dockerfile", dockerfile_hits(lines)).when(
        kind == "nextconfig", next_config_hits(lines)).otherwise(vercel_hits(content)))
    return _findings(rows, hits)


def gitignore_lines(files: DataFrame) -> DataFrame:
    """Root .gitignore per project: (project, gi_lines array of trimmed lines)."""
    return root_file(files, "/.gitignore").select(
        "project", F.transform(F.split(F.col("content"), "\n", -1), lambda l: js_trim(l)).alias("gi_lines"))


def env_findings(cfg: DataFrame, files: DataFrame) -> DataFrame:
    envs = cfg.where(F.col("kind") == "dotenv").select("project", "path", basename(F.col("path")).alias("name"))
    gi = gitignore_lines(files)
    j = envs.join(gi, "project", "left")
    forms = F.array(*map(F.lit, GITIGNORE_ENV_FORMS), F.col("name"), F.concat(F.lit("/"), F.col("name")))
    covered = F.coalesce(F.exists(F.col("gi_lines"), lambda l: F.array_contains(forms, l)), F.lit(False))
    return _findings(j.where(~covered), _fired(_hit("env-not-gitignored", F.lit(1), F.concat(
        F.col("name"), F.lit(" is not listed in .gitignore — secrets may be committed to git")))))


def config_findings(files: DataFrame, conform_schema: bool = True, cross_file: bool = True) -> DataFrame:
    """All configuration findings. ``cross_file=False`` leaves out the one
    check that needs another file of the project (.env vs root .gitignore),
    for callers that see only part of a project (micro-batches)."""
    cfg = config_files(files)
    out = file_findings(cfg).unionByName(compose_findings(cfg))
    if cross_file:
        out = out.unionByName(env_findings(cfg, files))
    return conform(out) if conform_schema else out
