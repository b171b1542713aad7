"""Domain tables derived from the driver tables.

The driver data holds prose, web pages, chats and TPC-H-like tables but no
source code, manifests or configuration, so this module derives them:

* ``files``     documents (+ planted lines), pages, chats and per-project
                root files (.gitignore, package.json, requirements.txt,
                deploy markers). ``project`` is the document ``source``.
* ``packages``  lineitem x part, aggregated per (project, ecosystem, name).
* ``advisories`` one nested advisory per part row.
* ``findings``  a findings table at volume (one row per lineitem row).

Every table is a plain Spark plan over the driver tables, so its work grows
with them. The same column expressions are rendered for DuckDB
(``duck_ctes``), which is how the SQL oracle sees identical inputs.

Planted values are synthetic: hashes of the document id, never real keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import DUCK, SPARK, Dialect

# ---------------------------------------------------------------------------
# Planted blocks: (path template, lines). Placeholders: {id} doc id,
# {A}/{B} alphanumeric tokens (38-43 chars), {AB:n} first n chars of A||B,
# {H:n} first n upper-case hex chars, {h:n} lower-case hex.
# ---------------------------------------------------------------------------
TEMPLATES: list[tuple[str, list[str]]] = [
    ("/src/routes/users{id}.js", [
        "const express = require('express');",
        "const router = express.Router();",
        "router.get('/api/v1/users/:id', async (req, res) => {",
        "  const user = await User.findById(req.params.id);",
        "  res.json(user);",
        "});",
        "router.post('/admin/reset', authenticate, (req, res) => res.send('ok'));",
        "const result = eval(req.body.expr);",
    ]),
    ("/src/db/query{id}.ts", [
        "import { PrismaClient } from '@prisma/client';",
        "import _ from 'lodash';",
        "const prisma = new PrismaClient();",
        "export async function find(req) {",
        "  const rows = await prisma.$queryRawUnsafe(`SELECT * FROM t WHERE id = ${req.query.id}`);",
        "  const more = await db.query(`SELECT * FROM u WHERE name = '${req.body.name}'`);",
        "  return _.merge({}, rows, more);",
        "}",
    ]),
    ("/src/utils/shell{id}.js", [
        "const { exec } = require('child_process');",
        "const fs = require('fs');",
        "const path = require('path');",
        "function run(req, res) {",
        "  exec(`ping -c 1 ${req.query.host}`);",
        "  child.execSync('ls ' + dir);",
        "  fs.readFile(path.join(__dirname, req.params.file), 'utf8', cb);",
        "  Object.assign(config, req.body);",
        "}",
    ]),
    ("/src/components/Widget{id}.tsx", [
        "import React from 'react';",
        "import axios from 'axios';",
        "export function Widget({ html }) {",
        "  const data = axios.get('/api/items');",
        "  return <div dangerouslySetInnerHTML={{ __html: html }} />;",
        "}",
        "export const Static = () => <div dangerouslySetInnerHTML={{ __html: '<b>ok</b>' }} />;",
    ]),
    ("/src/config/keys{id}.js", [
        "const awsKeyId = \"AKIA{H:16}\";",
        "const aws_secret_access_key = \"{AB:40}\";",
        "const api_key = \"{A}\";",
        "const jwtSecret = \"{B}\";",
    ]),
    ("/src/lib/client{id}.js", [
        "const fetch = require('node-fetch');",
        "const minimist = require('minimist');",
        "const args = minimist(process.argv.slice(2));",
        "// const oldToken = \"ghp_{AB:36}\";",
        "GITHUB_TOKEN = \"ghp_{AB:36}\";",
        "const res = await fetch(url);",
    ]),
    ("/services/svc{id}/Dockerfile", [
        "FROM node:latest",
        "WORKDIR /app",
        "COPY . .",
        "COPY .env /app/.env",
        "ENV API_KEY=sk_{B}",
        "RUN curl http://example.com/install.sh | sh",
        "USER root",
    ]),
    ("/services/api{id}/Dockerfile.prod", [
        "FROM python:3.12-slim",
        "RUN wget http://mirror.example.com/pkg.tgz",
        "ENV DB_PASSWORD=${DB_PASSWORD}",
        "USER appuser",
        "HEALTHCHECK CMD curl -f http://localhost/ || exit 1",
    ]),
    ("/deploy/stack{id}/docker-compose.yml", [
        "version: '3.8'",
        "services:",
        "  web:",
        "    image: nginx:1.25",
        "    ports:",
        "      - \"8080:80\"",
        "      - \"0.0.0.0:9229:9229\"",
        "    privileged: true",
        "  db:",
        "    image: postgres:16",
        "    environment:",
        "      - POSTGRES_PASSWORD=pw{h:10}",
        "      - POSTGRES_USER=${DB_USER}",
        "    ports:",
        "      - \"5432\"",
        "  cache:",
        "    image: redis:7",
        "    environment:",
        "      REDIS_TOKEN: tok{h:8}",
        "      LOG_LEVEL: debug",
    ]),
    ("/web/app{id}/next.config.js", [
        "module.exports = {",
        "  async headers() {",
        "    return [{ source: '/(.*)', headers: [",
        "      { key: 'Access-Control-Allow-Origin', value: '*' },",
        "    ] }];",
        "  },",
        "  env: { NEXT_PUBLIC_API_KEY: process.env.KEY },",
        "  images: { dangerouslyAllowSVG: true },",
        "};",
    ]),
    ("/services/svc{id}/.env", [
        "DATABASE_URL=postgres://app:{AB:12}@db{id}.internal:5432/app",
        "OPENAI_API_KEY=sk-{AB:20}T3BlbkFJ{B}",
        "# STRIPE_KEY=sk_live_{AB:24}",
        "SECRET_TOKEN={h:16}",
        "PORT=3000",
    ]),
    ("/services/web{id}/.env.local", [
        "SUPABASE_SERVICE_KEY=eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{A}{B}",
        "SLACK_TOKEN=xoxb-{h:12}-{AB:10}",
        "AWS_ACCESS_KEY_ID=ASIA{H:16}",
    ]),
    ("/test/fixtures/seed{id}.js", [
        "const api_key = \"{B}\";",
        "const password = \"hunter{h:6}\";",
        "app.get('/admin/stats', (req, res) => res.json(stats));",
    ]),
    ("/src/__tests__/auth{id}.test.ts", [
        "const token_secret = \"{A}\";",
        "router.delete('/account/:id', (req, res) => res.sendStatus(204));",
    ]),
    ("/docs/notes{id}.md", [
        "Use this key: AIza{AB:35}",
        "Webhook: https://hooks.slack.com/services/T{H:8}/B{H:8}/{AB:24}",
        "-----BEGIN RSA PRIVATE KEY-----",
    ]),
    ("/scripts/deploy{id}.sh", [
        "#!/bin/bash GITHUB=ghp_{AB:36}",
        "export VERCEL_TOKEN={AB:24}  # vercel",
        "npm_config_token=npm_{AB:36}",
        "curl -H \"Authorization: Bearer GOCSPX-{AB:28}\" http://example.com",
    ]),
    ("/src/api/payments{id}.ts", [
        "import express from 'express';",
        "import Stripe from 'stripe';",
        "const stripe = new Stripe(\"sk_live_{AB:24}\");",
        "app.post('/payment/charge', requireAuth, async (req, res) => {",
        "  const order = await Order.find(req.body);",
        "  const fn = new Function('a', req.body.code);",
        "});",
        "api.put('/profile/update', async (req, res) => res.json(await Profile.updateOne(req.body)));",
    ]),
    ("/pkg/mod{id}/index.mjs", [
        "import { merge } from 'lodash';",
        "import axios from 'axios';",
        "const m = await import('minimist');",
        "const fetch = require('node-fetch');",
        "export default function go(x) { return axios.post(x); }",
        "const apiSecret = 'sg{AB:18}';",
    ]),
    ("/public/assets/logo{id}.svg", [
        "<svg><!-- ghp_{AB:36} --></svg>",
    ]),
    ("/src/flows/long{id}.ts", [
        "/* a note on how not to",
        "   eval(req.body.code) */",
        "log('never exec(input) here', `or eval(x)`);",
        "const rows = await getDb(",
        "  'main', { pool: [1, 2] })",
        "  .query(",
        *[f"    // {n}" for n in range(12)],
        "    `SELECT * FROM t WHERE id = ${req.params.id}`,",
        "  );",
        "const user = await User",
        "  .find(req['body']);",
        "app.get('/admin/list', limiter({ max: 5 }), authenticate, handler);",
        "app.post('/admin/drop',",
        "  limiter({ max: 5 }), (req, res) => {",
        "    fs.readFile(path.join(root(1, 2), req.params.name), cb);",
        "  });",
        "const password =",
        "  'p{h:12}';",
        "router.exec(input, cb); db?.query(`x ${req.body.q}`); new Function('a', body);",
    ]),
    ("/deploy/wide{id}/docker-compose.prod.yml", [
        "version: '3'",
        "services:  # all of them",
        "    gate:",
        "        image: \"traefik:2\"  # pinned",
        "        privileged: true   # for now",
        "        ports: [\"0.0.0.0:9000:9000\", '5432', \"443:443\"]",
        "        environment: { ADMIN_TOKEN: t{h:8}, MODE: \"x # y\" }",
        "    work:",
        "        ports:",
        "        - 6379",
        "        - \"127.0.0.1:8080:8080\"",
        "        environment:",
        "        - API_KEY=k{h:9}",
        "        - \"DB_PASSWORD=${DB}\"",
        "        command: [",
        "            \"run\",",
        "        ]",
        "volumes:",
        "    data: {}",
    ]),
    ("/assets/blob{id}.cfg", [
        "head{NUL}token_secret = \"{A}\"",
    ]),
    ("/vendor/lib{id}.min.js", [
        "var k=\"AKIA{H:16}\";eval(x);",
    ]),
]

# Root files per project, chosen by a scramble of the project's first doc id.
GITIGNORE_VARIANTS = [
    ["node_modules", ".env", ".env.local", ""],
    ["node_modules", "*.env", "dist", ""],
    ["dist", "coverage", ""],
]
DEPLOY_MARKERS = [
    ("/vercel.json", ['{"headers": [{"source": "/(.*)", "headers": '
                      '[{"key": "Access-Control-Allow-Origin", "value": "*"}, '
                      '{"key": "X-Frame-Options", "value": "DENY"}]}]}']),
    ("/netlify.toml", ["[build]", "  command = \"npm run build\""]),
    ("/fly.toml", ["app = \"svc\"", "primary_region = \"ams\""]),
    ("/Dockerfile", ["FROM node:20-alpine", "USER node", "CMD [\"node\", \"server.js\"]"]),
    ("/railway.json", ['{"build": {"builder": "NIXPACKS"}}']),
]

# Package names mapped from part keys: the first names are the ones with
# known risky functions, then framework / database / auth markers.
PACKAGE_NAMES = ["lodash", "axios", "express", "minimist", "node-fetch", "next",
                 "react", "@prisma/client", "jsonwebtoken", "vue", "mongoose"]

_PH = re.compile(r"\{(id|A|B|AB|H|h|NUL)(?::(\d+))?\}")


def template_rows() -> list[tuple[int, str, str, bool]]:
    """(t, path template, body template, prose-as-yaml-comments) rows."""
    return [(i, p, "\n".join(lines), p.endswith((".yml", ".yaml"))) for i, (p, lines) in enumerate(TEMPLATES)]


def placeholders() -> list[str]:
    found = set()
    for p, lines in TEMPLATES:
        for x in [p, *lines]:
            found.update(m.group(0) for m in _PH.finditer(x))
    return sorted(found)


def _fill_sql(d: Dialect, col: str) -> str:
    """Nested replace() of every placeholder by its per-document value."""
    expr = col
    for ph in placeholders():
        m = _PH.fullmatch(ph)
        name, n = m.group(1), m.group(2)
        val = {"id": d.s("doc_id"), "A": "_ta", "B": "_tb",
               "AB": f"substr(_ta || _tb, 1, {n})", "H": f"substr(_hx, 1, {n})",
               "h": f"lower(substr(_hx, 1, {n}))", "NUL": "chr(0)"}[name]
        expr = f"replace({expr}, {d.lit(ph)}, {val})"
    return expr


def token_columns_sql(d: Dialect, key: str = "doc_id") -> dict[str, str]:
    """Per-document synthetic tokens, computed once and referenced by the
    templates as columns _ta, _tb (alphanumeric) and _hx (upper hex)."""
    return {"_ta": d.token("a", key), "_tb": d.token("b", key), "_hx": d.hexu("h", key)}


def template_index_sql(d: Dialect, key: str = "doc_id") -> str:
    return f"({d.mix(key)} % {len(TEMPLATES)})"


def planted_path_sql(d: Dialect) -> str:
    return _fill_sql(d, "path_tpl")


def planted_content_sql(d: Dialect, text: str = "text") -> str:
    prose = f"CASE WHEN yaml_prose THEN '# ' || {d.re_replace_all(text, chr(10), chr(10) + '# ')} ELSE {text} END"
    return f"{prose} || chr(10) || {_fill_sql(d, 'body_tpl')}"


def _lines_lit(d: Dialect, lines: list[str]) -> str:
    return d.lit("\n".join(lines)).replace("\n", "' || chr(10) || '")


def package_name_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PACKAGE_NAMES))
    return (f"CASE p_partkey % {len(PACKAGE_NAMES) + 4} {whens} "
            "ELSE replace(p_name, ' ', '-') END")


def ecosystem_sql() -> str:
    return (f"CASE WHEN p_partkey % {len(PACKAGE_NAMES) + 4} >= {len(PACKAGE_NAMES)} "
            "AND p_type IN ('STANDARD', 'PROMO') THEN 'PyPI' ELSE 'npm' END")


# ---------------------------------------------------------------------------
# Shared SQL expressions over one row of the named input
# ---------------------------------------------------------------------------

def _project_of(col: str, rows: int = 1) -> str:
    """A project for every ``rows`` ids, so that their number follows the data."""
    return f"'src' || CAST(CAST(floor({col} / {rows}) AS BIGINT) AS STRING)"


def root_variant_sql(d: Dialect) -> str:
    return f"{d.mix('d0')}"


def package_spec_sql() -> str:
    """Manifest version spec: a prefix chosen by name length, some wildcards."""
    return ("CASE length(name) % 7 WHEN 0 THEN '^' || version WHEN 1 THEN '~' || version "
            "WHEN 2 THEN '>=' || version WHEN 3 THEN version || ' - 9.0.0' "
            "WHEN 4 THEN '*' WHEN 5 THEN '<' || version ELSE version END")


def version_sql() -> str:
    """Plain, pre-release, four-part and date versions."""
    return ("CASE WHEN p_partkey % 29 = 7 THEN '2024010112345.' || CAST(p_size % 3 AS STRING) ELSE "
            "CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 20 AS STRING) || '.' || CAST(p_size % 10 AS STRING) "
            "|| CASE WHEN p_partkey % 17 = 2 THEN '-beta.' || CAST(p_size % 12 AS STRING) WHEN p_partkey % 17 = 5 THEN '-rc' "
            "WHEN p_partkey % 13 = 4 THEN '.' || CAST(p_size % 4 AS STRING) ELSE '' END END")


def advisory_exprs() -> dict[str, str]:
    """Flat advisory fields over ``part`` (shared by both engines)."""
    k = "p_partkey"
    return {
        "id": f"'GHSA-vg' || CAST({k} AS STRING)",
        "cve_alias": f"CASE WHEN {k} % 3 <> 0 THEN 'CVE-20' || CAST(20 + {k} % 5 AS STRING) || '-' || CAST(1000 + {k} AS STRING) END",
        "summary": f"CASE WHEN {k} % 7 <> 0 THEN 'Issue in ' || ({package_name_sql()}) || ' via ' || lower(p_type) || ' input' END",
        "details": f"CASE WHEN {k} % 2 = 0 THEN p_name || ' allows crafted ' || lower(p_type) || ' payloads' END",
        "sev_type": f"CASE WHEN {k} % 4 = 3 THEN NULL WHEN {k} % 8 = 2 THEN 'CVSS_V2' ELSE 'CVSS_V3' END",
        "sev_score": (f"CASE WHEN {k} % 4 = 1 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/' "
                      f"|| CAST(p_size % 10 AS STRING) || '.' || CAST({k} % 10 AS STRING) "
                      f"WHEN {k} % 4 = 3 THEN NULL ELSE 'CVSS:3.1/AV:N/AC:H/PR:L/UI:R/S:U/C:L/I:L/A:N' END"),
        "db_cvss": f"CASE WHEN {k} % 4 = 0 THEN CAST(p_size % 10 AS DOUBLE) + 0.5 WHEN {k} % 4 = 1 THEN 0.0 END",
        "db_severity": f"CASE WHEN {k} % 4 = 0 THEN 'HIGH' END",
        "cwe_id": f"CASE WHEN {k} % 5 <> 0 THEN 'CWE-' || CAST(79 + {k} % 5 AS STRING) END",
        "pkg_name": package_name_sql(),
        "pkg_ecosystem": ecosystem_sql(),
        "introduced": f"CASE WHEN {k} % 6 = 5 THEN NULL ELSE CAST(p_size % 3 AS STRING) || '.0.0' END",
        "fixed": (f"CASE WHEN {k} % 11 = 0 OR {k} % 7 = 5 THEN NULL ELSE CAST(p_size % 5 + 1 AS STRING) || '.' || CAST({k} % 10 AS STRING) || '.0' "
                  f"|| CASE WHEN {k} % 7 = 3 THEN '-rc.1' ELSE '' END END"),
        "last_affected": f"CASE WHEN {k} % 7 = 5 THEN CAST(p_size % 5 + 1 AS STRING) || '.' || CAST({k} % 20 AS STRING) END",
        "introduced2": f"CASE WHEN {k} % 8 = 1 AND {k} % 6 <> 5 AND {k} % 11 <> 0 THEN CAST(p_size % 5 + 2 AS STRING) || '.0.0-beta' END",
        "fixed2": f"CASE WHEN {k} % 8 = 1 AND {k} % 6 <> 5 AND {k} % 11 <> 0 AND {k} % 5 <> 0 THEN CAST(p_size % 5 + 2 AS STRING) || '.9.1.4' END",
        "extra_version": f"CASE WHEN {k} % 9 = 0 THEN CAST(p_size % 5 AS STRING) || '.' || CAST({k} % 20 AS STRING) || '.' || CAST(p_size % 10 AS STRING) END",
        "ref_type": f"CASE WHEN {k} % 10 = 0 THEN 'EVIDENCE' ELSE 'WEB' END",
        "ref_url": (f"CASE WHEN {k} % 10 = 5 THEN 'https://www.exploit-db.com/exploits/' || CAST({k} AS STRING) "
                    f"ELSE 'https://example.org/advisories/' || CAST({k} AS STRING) END"),
    }


def finding_exprs() -> dict[str, str]:
    """Volume findings over ``lineitem`` (shared by both engines)."""
    scanner = ("CASE l_linenumber WHEN 1 THEN 'sast' WHEN 2 THEN 'sca' WHEN 3 THEN 'secrets' "
               "WHEN 4 THEN 'iac' WHEN 5 THEN 'sast' WHEN 6 THEN 'sca' ELSE 'secrets' END")
    sast_rules = ["sql-injection-raw-unsafe", "sql-injection-template-literal", "command-injection",
                  "unsafe-eval", "path-traversal", "nosql-injection", "idor", "prototype-pollution",
                  "missing-auth-middleware", "xss-dangerous-inner-html", "hardcoded-credentials"]
    secret_rules = [("aws-access-key-id", "AWS Access Key ID"),
                    ("generic-api-key", "Generic API Key/Secret"),
                    ("github-token", "GitHub Personal Access Token"),
                    ("database-url", "Database Connection URL with credentials"),
                    ("jwt-secret", "JWT Secret")]
    iac_rules = ["dockerfile-root-user", "dockerfile-latest-tag", "dockerfile-secret-in-env",
                 "compose-port-exposure", "env-not-gitignored", "compose-privileged-container",
                 "nextjs-cors-wildcard"]

    def pick(values, key):
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {key} % {len(values)} {whens} END"

    rule = (f"CASE ({scanner}) WHEN 'sast' THEN {pick(sast_rules, 'l_partkey')} "
            f"WHEN 'sca' THEN 'vulnerable-dependency' "
            f"WHEN 'secrets' THEN {pick([r for r, _ in secret_rules], 'l_partkey')} "
            f"ELSE {pick(iac_rules, 'l_partkey')} END")
    secret_type = pick([dsc for _, dsc in secret_rules], "l_partkey")
    path = ("CASE WHEN l_linenumber IN (2, 6) THEN '/package.json' ELSE "
            "'/src/m' || CAST(l_partkey % 40 AS STRING) || "
            "CASE WHEN l_partkey % 9 = 0 THEN '/__tests__/' WHEN l_partkey % 13 = 0 THEN '/test/' ELSE '/' END "
            "|| 'f' || CAST(l_partkey % 7 AS STRING) || '.ts' END")
    is_sca = "l_linenumber IN (2, 6)"
    is_sec = "l_linenumber IN (3, 7)"
    return {
        "id": ("'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' "
               "|| CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' "
               "|| CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"),
        "project": _project_of("l_suppkey"),
        "scanner": scanner,
        "rule": rule,
        "severity": ("CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' "
                     "WHEN l_quantity >= 15 THEN 'medium' WHEN l_quantity >= 5 THEN 'low' ELSE 'info' END"),
        "confidence": ("CASE WHEN l_discount < 0.03 THEN 'high' WHEN l_discount < 0.07 THEN 'medium' "
                       "ELSE 'low' END"),
        "path": path,
        "line": f"CASE WHEN {is_sca} THEN 1 ELSE CAST(l_orderkey % 200 + 1 AS INT) END",
        "column": "CAST(l_linenumber * 2 AS INT)",
        "message": f"({rule}) || ' in ' || ({path})",
        "cwe": f"CASE WHEN {is_sca} THEN 'CWE-1035' WHEN {is_sec} THEN 'CWE-798' ELSE 'CWE-' || CAST(l_partkey % 900 AS STRING) END",
        "secret_type": f"CASE WHEN {is_sec} THEN {secret_type} END",
        "masked_value": (f"CASE WHEN {is_sec} THEN CASE WHEN l_partkey % 5 = 0 THEN '****' "
                         "ELSE 'k' || CAST(l_partkey % 97 AS STRING) || '****' || CAST(l_suppkey % 13 AS STRING) END END"),
        "package_name": f"CASE WHEN {is_sca} THEN 'pkg' || CAST(l_partkey % 50 AS STRING) END",
        "installed_version": f"CASE WHEN {is_sca} THEN CAST(l_partkey % 5 AS STRING) || '.' || CAST(l_partkey % 11 AS STRING) || '.0' END",
        "cve": f"CASE WHEN {is_sca} THEN 'CVE-2024-' || CAST(l_partkey % 400 AS STRING) END",
        "cvss_score": f"CASE WHEN {is_sca} THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) % 100 AS DOUBLE) / 10 END",
        "is_dev_dependency": f"CASE WHEN {is_sca} THEN l_partkey % 5 = 0 END",
        "is_direct": f"CASE WHEN {is_sca} THEN true END",
        "is_reachable": f"CASE WHEN {is_sca} THEN (l_partkey % 5 <> 0 AND l_partkey % 3 <> 0) END",
        "exploit_available": f"CASE WHEN {is_sca} THEN l_returnflag = 'R' END",
        "scan_ts": ("date_trunc('quarter', l_shipdate) + CASE WHEN l_orderkey % 2 = 0 THEN INTERVAL '9' DAY ELSE INTERVAL '23' DAY END"),
    }


FINDING_COLUMNS = list(finding_exprs().keys())

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    toks = [F.expr(v).alias(k) for k, v in token_columns_sql(SPARK).items()]
    docs = docs.select("doc_id", "source", "text", F.expr(template_index_sql(SPARK)).alias("t"), *toks)
    # the template table has a fixed, tiny size (one row per template)
    tpl = spark.createDataFrame(template_rows(), "t long, path_tpl string, body_tpl string, yaml_prose boolean")
    docs = docs.join(F.broadcast(tpl), "t")
    return docs.select(
        F.col("source").alias("project"),
        F.expr(planted_path_sql(SPARK)).alias("path"),
        F.expr(planted_content_sql(SPARK)).alias("content"),
    )


def extra_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(
        F.expr(_project_of("page_id", 50)).alias("project"),
        F.expr("'/public/pages/p' || CAST(page_id AS STRING) || '.html'").alias("path"),
        F.col("html").alias("content"))
    chats = read(spark, sf_dir, "conversations").select(
        F.expr(_project_of("conv_id", 50)).alias("project"),
        F.expr("'/docs/chats/c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '.md'").alias("path"),
        F.col("text").alias("content"))
    return pages.unionByName(chats)


def packages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, ecosystem, name, version, is_dev) from lineitem x part.

    One row per package per project: the version is the largest spec seen
    (string order), so the manifest has one entry per name.
    """
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    # part is a dimension: |part| = |lineitem| / 30 in TPC-H; AQE picks the join.
    j = li.join(part, li.l_partkey == part.p_partkey)
    rows = j.select(
        F.expr(_project_of("l_suppkey")).alias("project"),
        F.expr(ecosystem_sql()).alias("ecosystem"),
        F.expr(package_name_sql()).alias("name"),
        F.expr(version_sql()).alias("version"),
    )
    agg = rows.groupBy("project", "ecosystem", "name").agg(F.max("version").alias("version"))
    return agg.withColumn(
        "is_dev", F.expr("(length(name) + CAST(substr(project, 4) AS INT)) % 4 = 0"))


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    projects = docs.groupBy(F.col("source").alias("project")).agg(F.min("doc_id").alias("d0"))
    v = F.expr(root_variant_sql(SPARK))
    gi_cases = F.expr(
        "CASE " + " ".join(f"WHEN {root_variant_sql(SPARK)} % {len(GITIGNORE_VARIANTS)} = {i} "
                           f"THEN {_lines_lit(SPARK, lines)}"
                           for i, lines in enumerate(GITIGNORE_VARIANTS)) + " END")
    gitignore = projects.select("project", F.lit("/.gitignore").alias("path"), gi_cases.alias("content"))
    marker_rows = []
    for i, (path, lines) in enumerate(DEPLOY_MARKERS):
        marker_rows.append(
            projects.where(v % (len(DEPLOY_MARKERS) + 1) == i)
            .select("project", F.lit(path).alias("path"),
                    F.expr(_lines_lit(SPARK, lines)).alias("content")))
    turbo = (projects.where(v % 4 == 0)
             .select("project", F.lit("/turbo.json").alias("path"), F.lit('{"pipeline": {}}').alias("content")))
    out = gitignore.unionByName(turbo)
    for m in marker_rows:
        out = out.unionByName(m)

    pk = packages_raw(spark, sf_dir)
    npm = pk.where(F.col("ecosystem") == "npm").withColumn("spec", F.expr(package_spec_sql()))
    entry = F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("spec"), F.lit('"'))
    manifest = npm.groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("is_dev"), entry))), ", ").alias("deps"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_dev"), entry))), ", ").alias("dev"),
    ).select(
        "project", F.lit("/package.json").alias("path"),
        F.concat(F.lit('{"name": "'), F.col("project"), F.lit('", "dependencies": {'), F.col("deps"),
                 F.lit('}, "devDependencies": {'), F.col("dev"), F.lit("}}")).alias("content"))
    pypi = pk.where(F.col("ecosystem") == "PyPI")
    req_line = F.expr("name || CASE length(name) % 3 WHEN 0 THEN '==' WHEN 1 THEN '>=' ELSE '~=' END || version")
    reqs = pypi.groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list(req_line)), "\n").alias("body")
    ).select("project", F.lit("/requirements.txt").alias("path"),
             F.concat(F.lit("# pinned\n-r base.txt\n\n"), F.col("body"), F.lit("\n")).alias("content"))
    return out.unionByName(manifest).unionByName(reqs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus: (project, path, content)."""
    return (doc_files(spark, sf_dir)
            .unionByName(extra_files(spark, sf_dir))
            .unionByName(root_files(spark, sf_dir)))


#: The events of an advisory's range in order: kind, expression.
EVENTS = (("introduced", "introduced"), ("fixed", "fixed"), ("last_affected", "last_affected"),
          ("introduced", "introduced2"), ("fixed", "fixed2"))


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested advisory records, one per part row (same shape as the JSON feed)."""
    part = read(spark, sf_dir, "part")
    e = {k: F.expr(v) for k, v in advisory_exprs().items()}
    return part.select(
        e["id"].alias("id"),
        F.filter(F.array(e["cve_alias"]), lambda x: x.isNotNull()).alias("aliases"),
        e["summary"].alias("summary"),
        e["details"].alias("details"),
        F.when(e["sev_type"].isNull(), F.array().cast("array<struct<type:string,score:string>>"))
        .otherwise(F.array(F.struct(e["sev_type"].alias("type"), e["sev_score"].alias("score"))))
        .alias("severity"),
        F.array(F.struct(
            F.struct(e["pkg_name"].alias("name"), e["pkg_ecosystem"].alias("ecosystem")).alias("package"),
            F.array(F.struct(
                F.lit("SEMVER").alias("type"),
                F.filter(F.array(*(F.struct(*((e[source] if field == kind else F.lit(None).cast("string")).alias(field)
                                              for field in ("introduced", "fixed", "last_affected")))
                                   for kind, source in EVENTS)),
                         lambda ev: F.coalesce(ev["introduced"], ev["fixed"], ev["last_affected"]).isNotNull()).alias("events"),
            )).alias("ranges"),
            F.filter(F.array(e["extra_version"]), lambda x: x.isNotNull()).alias("versions"),
        )).alias("affected"),
        F.array(F.struct(e["ref_type"].alias("type"), e["ref_url"].alias("url"))).alias("references"),
        F.struct(e["db_severity"].alias("severity"), e["db_cvss"].alias("cvss_score"),
                 F.filter(F.array(e["cwe_id"]), lambda x: x.isNotNull()).alias("cwe_ids"))
        .alias("database_specific"),
    )


def findings_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per lineitem row, in the ``findings`` schema."""
    from ..schemas import conform
    li = read(spark, sf_dir, "lineitem")
    cols = [F.expr(v).alias(k) for k, v in finding_exprs().items()]
    return conform(li.select(*cols))


# ---------------------------------------------------------------------------
# DuckDB side: the same tables as CTE text over the pre-registered views
# ---------------------------------------------------------------------------


def duck_ctes() -> dict[str, str]:
    d = DUCK
    ctes: dict[str, str] = {}
    toks = ", ".join(f"{v} AS {k}" for k, v in token_columns_sql(d).items())
    vals = ", ".join(f"({t}, {d.lit(p)}, {d.lit(b)}, {'true' if y else 'false'})" for t, p, b, y in template_rows())
    ctes["templates"] = f"SELECT * FROM (VALUES {vals}) v(t, path_tpl, body_tpl, yaml_prose)"
    ctes["doc_files"] = (f"SELECT source AS project, {planted_path_sql(d)} AS path, "
                         f"{planted_content_sql(d)} AS content FROM (SELECT doc_id, source, text, "
                         f"{template_index_sql(d)} AS t, {toks} FROM documents) x JOIN templates USING (t)")
    ctes["extra_files"] = (
        f"SELECT {_project_of('page_id', 50)} AS project, '/public/pages/p' || CAST(page_id AS STRING) || '.html' AS path, html AS content FROM pages "
        f"UNION ALL SELECT {_project_of('conv_id', 50)} AS project, '/docs/chats/c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '.md' AS path, text AS content FROM conversations")
    ctes["packages_raw"] = (
        "SELECT project, ecosystem, name, max(version) AS version, "
        "(length(name) + CAST(substr(project, 4) AS INT)) % 4 = 0 AS is_dev FROM ("
        f"SELECT {_project_of('l_suppkey')} AS project, {ecosystem_sql()} AS ecosystem, {package_name_sql()} AS name, "
        f"{version_sql()} AS version "
        "FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY project, ecosystem, name")
    ctes["projects0"] = "SELECT source AS project, min(doc_id) AS d0 FROM documents GROUP BY source"
    v = root_variant_sql(d)
    gi = "CASE " + " ".join(f"WHEN {v} % {len(GITIGNORE_VARIANTS)} = {i} THEN {_lines_lit(d, lines)}"
                            for i, lines in enumerate(GITIGNORE_VARIANTS)) + " END"
    parts = [f"SELECT project, '/.gitignore' AS path, {gi} AS content FROM projects0",
             "SELECT project, '/turbo.json' AS path, '{\"pipeline\": {}}' AS content FROM projects0 "
             f"WHERE {v} % 4 = 0"]
    for i, (path, lines) in enumerate(DEPLOY_MARKERS):
        parts.append(f"SELECT project, '{path}' AS path, {_lines_lit(d, lines)} AS content FROM projects0 "
                     f"WHERE {v} % {len(DEPLOY_MARKERS) + 1} = {i}")
    entry = "'\"' || name || '\": \"' || spec || '\"'"
    parts.append(
        "SELECT project, '/package.json' AS path, '{\"name\": \"' || project || '\", \"dependencies\": {' || "
        f"coalesce(string_agg({entry}, ', ' ORDER BY {entry}) FILTER (WHERE NOT is_dev), '') || "
        f"'}}, \"devDependencies\": {{' || coalesce(string_agg({entry}, ', ' ORDER BY {entry}) FILTER (WHERE is_dev), '') || '}}}}' AS content "
        f"FROM (SELECT *, {package_spec_sql()} AS spec FROM packages_raw WHERE ecosystem = 'npm') GROUP BY project"
        )
    req_line = ("name || CASE length(name) % 3 WHEN 0 THEN '==' WHEN 1 THEN '>=' ELSE '~=' END || version")
    parts.append(
        "SELECT project, '/requirements.txt' AS path, '# pinned' || chr(10) || '-r base.txt' || chr(10) || chr(10) || "
        f"string_agg({req_line}, chr(10) ORDER BY {req_line}) || chr(10) AS content "
        "FROM packages_raw WHERE ecosystem = 'PyPI' GROUP BY project")
    ctes["root_files"] = " UNION ALL ".join(f"({p})" for p in parts)
    ctes["files"] = ("SELECT * FROM doc_files UNION ALL SELECT * FROM extra_files "
                     "UNION ALL SELECT * FROM root_files")
    a = advisory_exprs()
    ctes["advisories_flat"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in a.items()) + " FROM part"
    from ..plans.oracle import conform_sql
    fx = finding_exprs()
    ctes["findings_volume"] = "SELECT " + conform_sql({k: f"({v})" for k, v in fx.items()}) + " FROM lineitem"
    return ctes
