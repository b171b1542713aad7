"""Queries of the minimum slice: corpus -> secrets -> triage -> score."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import corpus
from . import oracle as O
from .queries import query
from .scan import ScanPlan


class Corpus:
    """Handles on the derived domain tables of one driver data folder.

    The derived tables (files, advisories, volume findings) are written once
    as parquet under the session's shared checkpoint folder and read back,
    so every query scans a columnar table (pushdown, pruning) instead of
    recomputing the derivation, and lineage is cut at a durable table that
    survives executor loss. Keyed by the data folder and a corpus version.
    """

    @staticmethod
    def _version() -> str:
        """Changes whenever the corpus generator or file layout changes."""
        import hashlib
        import inspect
        from ..sources import dialect, files
        src = inspect.getsource(corpus) + inspect.getsource(dialect) + inspect.getsource(files.file_kind)
        return hashlib.sha1(src.encode()).hexdigest()[:10]
    TABLES = {"files": corpus.files, "advisories": corpus.advisories, "findings": corpus.findings_volume,
              "context": lambda spark, sf_dir: _context_of(corpus_of(spark, sf_dir).files)}

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark, self.sf_dir, self.materialize = spark, sf_dir, materialize
        self._cache = {}

    def _location(self, name: str) -> str:
        import hashlib
        import os
        from ..session import ensure_checkpoint_dir
        # staged for one application: another one may see other data in the same folder
        where = self.sf_dir if "://" in self.sf_dir else os.path.abspath(self.sf_dir)
        app = self.spark.sparkContext.applicationId
        key = hashlib.sha1(f"{where}|{self._version()}|{app}".encode()).hexdigest()[:16]
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/vigil-corpus/{key}/{name}"

    def _get(self, name):
        if name in self._cache:
            return self._cache[name]
        build = self.TABLES[name]
        if not self.materialize:
            df = build(self.spark, self.sf_dir)
        else:
            loc = self._location(name)
            if not _committed(self.spark, loc):
                # files come from a union of differently sized inputs (pages are few but long): an even
                # row spread; findings are as evenly spread as the rows they are made of, and not shuffled
                n = max(8, 2 * self.spark.sparkContext.defaultParallelism)
                out = build(self.spark, self.sf_dir)
                if name == "files":
                    from ..sources.files import file_kind
                    # partitioned by kind: selectors prune to their slice
                    out.withColumn("kind", file_kind(F.col("path"))).repartition(n).write.mode("overwrite").partitionBy("kind").parquet(loc)
                else:
                    (out if name == "findings" else out.repartition(n)).write.mode("overwrite").parquet(loc)
            df = self.spark.read.parquet(loc)
        self._cache[name] = df
        return df

    @property
    def files(self):
        return self._get("files")

    @property
    def advisories(self):
        return self._get("advisories")

    @property
    def findings(self):
        return self._get("findings")

    @property
    def context(self):
        """Per-project context as a written table: its exact size is known
        to the planner, which broadcasts it only below the broadcast
        threshold (else a shuffle join with AQE skew splitting)."""
        return self._get("context")

    def plan(self, stage: bool = True, **kw) -> ScanPlan:
        import hashlib
        tag = hashlib.sha1(repr(sorted(kw.items())).encode()).hexdigest()[:8]
        name = f"{self._location('raw_findings').rsplit('/', 2)[-2]}-raw-{tag}" if stage else None
        return ScanPlan(self.files, self.advisories, context=self.context, stage_as=name, **kw)


def _context_of(files):
    from ..operators.context import project_context
    return project_context(files)


def _committed(spark: SparkSession, location: str) -> bool:
    """True when a completed write left its _SUCCESS marker (any Hadoop FS)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location + "/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path))


_CORPORA: dict = {}


def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        _CORPORA[key] = Corpus(spark, sf_dir)
    return _CORPORA[key]


def _scores_sql(src_prefix: str) -> str:
    return (f"SELECT project, {O.sev_counts_select()}, "
            f"CAST(count(*) FILTER (WHERE {O.active_sql()}) AS BIGINT) AS total FROM {src_prefix}_triaged GROUP BY project")


def _with_score(inner: str) -> str:
    s = O.score_sql("critical", "high", "medium", "low", "info")
    return (f"SELECT *, {s} AS security_score, {O.grade_sql(s)} AS grade, {O.band_sql(s)} AS score_band "
            f"FROM ({inner})")


@O.register_ctes
def _secret_triage_ctes():
    return O.triage_ctes("secret_findings", "ss")


@query("secret_findings", "2.3")
def q_secret_findings(spark, sf_dir):
    from ..operators.secrets import secret_findings
    return secret_findings(corpus_of(spark, sf_dir).files)


@query("scan_secrets_score", "7.1")
def q_scan_secrets_score(spark, sf_dir):
    """Flagship: which projects leak secrets, and what is their score?"""
    return corpus_of(spark, sf_dir).plan(scanners=("secrets",)).scores()


ORACLE = {
    "secret_findings": lambda: O.with_ctes("SELECT * FROM secret_findings", ["secret_findings"]),
    "scan_secrets_score": lambda: O.with_ctes(_with_score(_scores_sql("ss")), ["ss_triaged"]),
}
