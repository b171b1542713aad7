"""File sources: read a directory tree as a ``files`` table, and the
per-scanner file selections (include / ignore globs as path predicates).

Paths are project-relative and start with '/'. Every selector is a plain
``where`` on ``path`` so Catalyst pushes it below the line explode (and to
the parquet scan when ``files`` is stored partitioned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

# Fixed values that must equal the reference's for right results.
# Directory names whose subtree each scanner ignores.
CODE_IGNORE_DIRS = ["node_modules", "dist", "build", ".next", "coverage", "vendor"]
SECRET_IGNORE_DIRS = ["node_modules", ".git", "dist", "build", ".next", "coverage"]
CONFIG_IGNORE_DIRS = ["node_modules", ".git", "dist", ".next", "coverage"]
IMPORT_IGNORE_DIRS = ["node_modules", "dist", "build", ".next"]
# Secret scanner skip list (unanchored regexes on the path, as written).
SECRET_SKIP_PATTERNS = [
    r"node_modules",
    r"\.git\/",
    r"dist\/",
    r"build\/",
    r"coverage\/",
    r"\.next\/",
    r"package-lock\.json$",
    r"yarn\.lock$",
    r"pnpm-lock\.yaml$",
    r"\.env\.example$",
    r"\.env\.sample$",
    r"\.env\.template$",
    r"(?i)\.(png|jpg|jpeg|gif|ico|svg|woff|woff2|ttf|eot|pdf|zip|tar|gz)$",
]
# Config file names (by basename) and the analyzer kind they route to.
CONFIG_NAME_RE = (r"^(Dockerfile|Dockerfile\..*|docker-compose.*\.ya?ml|next\.config\.(js|ts|mjs)"
                  r"|vercel\.json|\.env|\.env\.local|\.env\.production|\.env\.development"
                  r"|netlify\.toml|fly\.toml|railway\.json)$")
CONFIG_EXCLUDE_NAME_RE = r"^\.env\.(example|sample|template)$"


# Storage layout: a ``files`` table written partitioned by ``kind`` lets
# each selector read only its slice (partition pruning); selectors add the
# kind predicate only when the column exists, so any (project, path,
# content) table works too.
KIND_META = ["package.json", "requirements.txt", ".gitignore"]
CODE_KINDS = ["code", "code_config"]
CONFIG_KINDS = ["config", "code_config"]


def file_kind(path: Column) -> Column:
    b = basename(path)
    code_ext = path.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)\z")
    config = b.rlike(CONFIG_NAME_RE)
    return (F.when(b.isin(KIND_META), "meta").when(code_ext & config, "code_config")
            .when(config, "config").when(code_ext, "code").otherwise("other"))


def of_kind(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Partition-pruning predicate, applied only to kind-partitioned tables."""
    return files.where(F.col("kind").isin(kinds)) if "kind" in files.columns else files


def java_re(js_pattern: str) -> str:
    """JavaScript regex source -> Java: '$' at the very end becomes '\\z'
    (Java's '$' would also match before a trailing line terminator)."""
    if js_pattern.endswith("$") and not js_pattern.endswith("\\$"):
        return js_pattern[:-1] + r"\z"
    return js_pattern


def _under_dir(path: Column, dirs: list[str]) -> Column:
    alt = "|".join(d.replace(".", r"\.") for d in dirs)
    return path.rlike(rf"(^|/)({alt})/")


def _has_dot_segment(path: Column) -> Column:
    """fast-glob without ``dot: true`` skips dot files and dot directories."""
    return path.rlike(r"(^|/)\.")


def code_files(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return of_kind(files, CODE_KINDS).where(
        p.rlike(r"\.(js|jsx|ts|tsx)\z") & ~_under_dir(p, CODE_IGNORE_DIRS)
        & ~p.rlike(r"\.min\.js\z") & ~p.rlike(r"\.d\.ts\z") & ~_has_dot_segment(p))


def secret_files(files: DataFrame) -> DataFrame:
    p = F.col("path")
    skip = "|".join(f"(?:{java_re(x)})" for x in SECRET_SKIP_PATTERNS if not x.startswith("(?i)"))
    skip_ci = java_re(SECRET_SKIP_PATTERNS[-1])
    return files.where(
        ~_under_dir(p, SECRET_IGNORE_DIRS) & ~p.rlike(r"\.min\.js\z")
        & ~p.rlike(skip) & ~p.rlike(skip_ci))


def root_file(files: DataFrame, path: str) -> DataFrame:
    """The project-root file ``path`` (manifests, .gitignore) of every project."""
    f = of_kind(files, ["meta"]) if path.rsplit("/", 1)[-1] in KIND_META else files
    return f.where(F.col("path") == path)


def without_binary(files: DataFrame) -> DataFrame:
    """Drop files whose content holds a NUL character."""
    return files.where(~F.contains(F.col("content"), F.lit("\u0000")))


def config_files(files: DataFrame) -> DataFrame:
    """Config files with the analyzer ``kind`` they route to (null: none)."""
    p = F.col("path")
    b = basename(p)
    kind = (F.when((b == "Dockerfile") | b.startswith("Dockerfile."), "dockerfile")
            .when(b.startswith("docker-compose"), "compose")
            .when(b.startswith("next.config"), "nextconfig")
            .when(b == "vercel.json", "vercel")
            .when(b.startswith(".env"), "dotenv"))
    return (of_kind(files, CONFIG_KINDS).where(b.rlike(CONFIG_NAME_RE) & ~b.rlike(CONFIG_EXCLUDE_NAME_RE)
                        & ~_under_dir(p, CONFIG_IGNORE_DIRS))
            .withColumn("kind", kind))


def import_files(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return of_kind(files, CODE_KINDS).where(p.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)\z")
                       & ~_under_dir(p, IMPORT_IGNORE_DIRS) & ~_has_dot_segment(p))


def counted_source_files(files: DataFrame) -> DataFrame:
    """Files counted as 'scanned': 8 source extensions outside 3 directories."""
    p = F.col("path")
    return files.where(p.rlike(r"\.(js|jsx|ts|tsx|py|go|rs|java)\z")
                       & ~p.rlike(r"(^|/)(node_modules|\.git|dist)/"))


def read_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Read a directory tree of text files into ``files``.

    Uses the binary file source (one row per file, read by executors), so a
    corpus of many projects is read in parallel; ``project`` defaults to the
    first directory under ``root``.
    """
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .load(root)
           .select("path", "content"))
    root_uri = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^(file:)?" + root_uri.replace(".", r"\.") + "/?", "")
    if project is None:
        proj = F.split(rel, "/").getItem(0)
        rel_path = F.concat(F.lit("/"), F.regexp_replace(rel, r"^[^/]+/?", ""))
    else:
        proj = F.lit(project)
        rel_path = F.concat(F.lit("/"), rel)
    return raw.select(proj.alias("project"), rel_path.alias("path"),
                      F.decode(F.col("content"), "UTF-8").alias("content"))
