"""Project context: frameworks, database / auth use, deploy target, tests.

Two one-row-per-project aggregates joined on project: presence flags from
``path`` alone (column pruning keeps ``content`` out of that scan), and the
parsed root ``package.json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_object
from ..sources.files import root_file

# Fixed values that must equal the reference's for right results.
# (dependency name, framework label) in detection order.
FRAMEWORK_MARKERS = [
    ("next", "nextjs"), ("react", "react"), ("express", "express"), ("fastify", "fastify"),
    ("koa", "koa"), ("@nestjs/core", "nestjs"), ("nuxt", "nuxt"), ("vue", "vue"),
    ("svelte", "svelte"), ("remix", "remix"),
]
DATABASE_PACKAGES = ["prisma", "@prisma/client", "mongoose", "sequelize", "typeorm", "pg",
                     "mysql2", "mongodb", "better-sqlite3", "sqlite3"]
AUTH_PACKAGES = ["next-auth", "@auth/core", "passport", "passport-jwt", "jsonwebtoken",
                 "@supabase/supabase-js", "@clerk/nextjs", "@clerk/clerk-sdk-node", "auth0", "jose"]
# Deploy target by root marker, first present wins: (paths, target, public).
DEPLOY_RULES = [
    (["/vercel.json", "/.vercel"], "vercel", True),
    (["/netlify.toml"], "netlify", True),
    (["/fly.toml"], "aws", True),
    (["/Dockerfile"], "docker", False),
    (["/railway.json"], "aws", True),
]
MONOREPO_MARKERS = ["/turbo.json", "/pnpm-workspace.yaml"]
PYTHON_MARKERS = ["/requirements.txt", "/pyproject.toml", "/setup.py"]
TEST_DIRS = ["__tests__", "test", "tests", "spec"]

MANIFEST_SCHEMA = T.StructType([
    T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("workspaces", T.StringType()),
])


def _exists(paths: list[str]):
    """Root entry present: the file itself or anything under that directory."""
    p = F.col("path")
    cond = None
    for x in paths:
        c = (p == x) | p.startswith(x + "/")
        cond = c if cond is None else cond | c
    return F.max(cond.cast("int")) == 1


def parse_manifest(content) -> "F.Column":
    return json_object(content, MANIFEST_SCHEMA)


def project_context(files: DataFrame) -> DataFrame:
    presence_cols = {
        "_has_pkg": ["/package.json"],
        "_monorepo_file": MONOREPO_MARKERS,
        "_python": PYTHON_MARKERS,
        "_tests": [f"/{d}" for d in TEST_DIRS],
    }
    aggs = [_exists(v).alias(k) for k, v in presence_cols.items()]
    aggs += [_exists(paths).alias(f"_deploy{i}") for i, (paths, _, _) in enumerate(DEPLOY_RULES)]
    presence = files.select("project", "path").groupBy("project").agg(*aggs)

    pkg = root_file(files, "/package.json").select(
        "project", parse_manifest(F.col("content")).alias("m"))
    # value truthiness: a dependency with an empty spec does not count
    deps = F.map_filter(F.map_concat(F.coalesce(F.col("m.dependencies"), F.create_map().cast("map<string,string>")),
                                     F.coalesce(F.col("m.devDependencies"), F.create_map().cast("map<string,string>"))),
                        lambda k, v: F.length(v) > 0)
    pkg = pkg.select("project", deps.alias("deps"), F.col("m.workspaces").alias("workspaces"),
                     F.col("m").isNotNull().alias("_parsed"))
    # one manifest per project root; max() keeps the plan a plain aggregate
    pkg = pkg.groupBy("project").agg(F.first("deps").alias("deps"), F.first("workspaces").alias("workspaces"),
                                     F.max("_parsed").alias("_parsed"))

    j = presence.join(pkg, "project", "left")
    has = lambda name: F.coalesce(F.map_contains_key(F.col("deps"), F.lit(name)), F.lit(False))
    frameworks = F.filter(F.array(*[F.when(has(dep), F.lit(label)) for dep, label in FRAMEWORK_MARKERS]),
                          lambda x: x.isNotNull())
    parsed = F.coalesce(F.col("_parsed"), F.lit(False))
    any_of = lambda names: F.coalesce(F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(F.col("deps"), n)), F.lit(False))
    target = F.lit("unknown")
    public = F.lit(False)
    for i, (_, t, pub) in reversed(list(enumerate(DEPLOY_RULES))):
        target = F.when(F.col(f"_deploy{i}"), F.lit(t)).otherwise(target)
        public = F.when(F.col(f"_deploy{i}"), F.lit(pub)).otherwise(public)
    language = F.concat(
        F.when(parsed & has("typescript"), F.array(F.lit("typescript"))).otherwise(F.array().cast("array<string>")),
        F.when(parsed, F.array(F.lit("javascript"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_python"), F.array(F.lit("python"))).otherwise(F.array().cast("array<string>")))
    return j.select(
        "project",
        (parsed & any_of(DATABASE_PACKAGES)).alias("has_database"),
        (parsed & any_of(AUTH_PACKAGES)).alias("has_authentication"),
        public.alias("is_publicly_deployed"),
        F.when(parsed, frameworks).otherwise(F.array().cast("array<string>")).alias("frameworks"),
        (parsed & (F.col("workspaces").isNotNull() | F.col("_monorepo_file"))).alias("is_monorepo"),
        F.col("_tests").alias("has_tests"),
        target.alias("deploy_target"),
        language.alias("language"),
    )


def framework_of(files: DataFrame) -> DataFrame:
    """Per project, the guardrail framework: the first file (in path order)
    whose path hits a framework marker, else 'generic'."""
    p = F.col("path")
    has = lambda x: F.contains(p, F.lit(x))
    # Marker substrings, checked in this order per file.
    fw = (F.when(has("next.config") | has("pages/") | has("app/"), "nextjs")
          .when(has("express"), "express")
          .when(has("flask") | has("app.py"), "flask")
          .when(has("fastapi") | has("main.py"), "fastapi"))
    hits = files.select("project", "path", fw.alias("fw")).where(F.col("fw").isNotNull())
    per = hits.groupBy("project").agg(F.min_by("fw", "path").alias("framework"))
    projects = files.select("project").distinct()
    return projects.join(per, "project", "left").select(
        "project", F.coalesce(F.col("framework"), F.lit("generic")).alias("framework"))
