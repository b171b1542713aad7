"""Reachability of vulnerable dependencies.

Imports are extracted from every import-capable file in one pass (three
``regexp_extract_all``), together with five per-file "risky function used"
flags, so file ``content`` never travels through a shuffle: the import map
is (project, package, file, risky_used) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import import_files
from .ranking import numbered

# Fixed values that must equal the reference's for right results.
IMPORT_PATTERNS = [
    r"""import\s+(?:[^'"]*?\s+from\s+)?['"]([^'"./][^'"]*)['"]""",
    r"""import\s*\(\s*['"]([^'"./][^'"]*)['"]\s*\)""",
    r"""require\s*\(\s*['"]([^'"./][^'"]*)['"]\s*\)""",
]
RISKY_FUNCTIONS = {
    "lodash": [r"\.(merge|mergeWith|defaultsDeep)\s*\(", r"\.(template)\s*\("],
    "axios": [r"axios\."],
    "express": [r"express\s*\(\)"],
    "minimist": [r"minimist\s*\("],
    "node-fetch": [r"fetch\s*\("],
}
REASON_DEV = "Package is a dev dependency and not used in production builds"


def normalize_package(spec: Column) -> Column:
    """'@scope/x/y' -> '@scope/x'; 'a/b' -> 'a'."""
    return F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def _risky_flag(pkg: str) -> Column:
    return F.col("content").rlike("|".join(f"(?:{p})" for p in RISKY_FUNCTIONS[pkg]))


def imports(files: DataFrame) -> DataFrame:
    """Distinct (project, package, file, risky_used)."""
    f = import_files(files)
    specs = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in IMPORT_PATTERNS])
    flags = F.create_map(*[x for k in RISKY_FUNCTIONS for x in (F.lit(k), _risky_flag(k))])
    e = f.select("project", F.col("path").alias("file"), flags.alias("flags"),
                 F.explode(specs).alias("spec"))
    pkg = normalize_package(F.col("spec"))
    return e.select("project", pkg.alias("package"), "file",
                    F.coalesce(F.try_element_at(F.col("flags"), pkg), F.lit(False)).alias("risky_used")).distinct()


#: Most files on one page of a package's list.
PAGE_FILES = 1000


def import_map(imps: DataFrame, page_files: int = PAGE_FILES) -> DataFrame:
    """package -> its distinct files in order, per project, in pages from 1 of at most ``page_files``; n_files is the whole
    list's length. A package in a million files has a thousand rows, and no task holds more than a page of it."""
    files = imps.select("project", "package", "file").distinct()
    counts = files.groupBy("project", "package").agg(F.count(F.lit(1)).alias("n_files"))
    placed = numbered(files, ["project", "package"], [F.col("file")])
    page = (F.floor((F.col("rank") - 1) / page_files) + 1).cast("int").alias("page")
    pages = placed.groupBy("project", "package", page).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return pages.join(counts, ["project", "package"])


def package_usage(imps: DataFrame) -> DataFrame:
    """Per (project, package): counts of importing files and of files calling a risky function. The files themselves
    are ``import_map`` of all imports, or of those with ``risky_used``."""
    return imps.groupBy("project", "package").agg(
        F.count(F.lit(1)).alias("n_imported"), F.count_if(F.col("risky_used")).alias("n_used")).withColumn(
        "has_patterns", F.col("package").isin(list(RISKY_FUNCTIONS)))


def reachability(sca: DataFrame, files: DataFrame) -> DataFrame:
    """Dependency findings + is_reachable, reachability_reason."""
    usage = package_usage(imports(files)).withColumnRenamed("package", "package_name")
    j = sca.join(usage, ["project", "package_name"], "left")
    name = F.col("package_name")
    imported = F.coalesce(F.col("n_imported"), F.lit(0)) > 0
    used = F.coalesce(F.col("n_used"), F.lit(0)) > 0
    patterns = F.coalesce(F.col("has_patterns"), name.isin(list(RISKY_FUNCTIONS)))
    dev = F.coalesce(F.col("is_dev_dependency"), F.lit(False))
    reachable = F.when(dev, False).when(~imported, False).when(patterns & ~used, False).otherwise(True)
    n_files = F.when(patterns, F.col("n_used")).otherwise(F.col("n_imported"))
    reason = (F.when(dev, F.lit(REASON_DEV))
              .when(~imported, F.concat(F.lit("Package '"), name, F.lit("' is not directly imported in any source file")))
              .when(patterns & ~used, F.concat(F.lit("Package '"), name, F.lit("' is imported but vulnerable functions are not called")))
              .otherwise(F.concat(F.lit("Package '"), name, F.lit("' is actively used in "),
                                  n_files.cast("string"), F.lit(" file(s)"))))
    out = j.withColumn("is_reachable", reachable).withColumn("reachability_reason", reason)
    return out.drop("n_imported", "n_used", "has_patterns")


def package_reachability(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages of projects + is_reachable, reachability_reason: what ``reachability`` says of all findings of a package, which
    does not depend on the advisory, so imports meet a package once."""
    named = packages.withColumn("package_name", F.col("name")).withColumn("is_dev_dependency", F.col("is_dev"))
    return reachability(named, files).drop("package_name", "is_dev_dependency")


def apply_reachability(sca: DataFrame, files: DataFrame) -> DataFrame:
    """Findings schema preserved: only ``is_reachable`` is updated."""
    cols = sca.columns
    return reachability(sca, files).select(*cols)


def function_usage(files: DataFrame) -> DataFrame:
    """Files that call a known-risky function of a package they import."""
    return imports(files).where(F.col("risky_used")).select("project", "package", "file")
