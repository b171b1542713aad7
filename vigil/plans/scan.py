"""The scan pipeline as one lazy Spark plan.

files -> findings_{sast, secrets, iac}; packages x advisories -> findings_sca;
union -> reachability -> context rules -> dedup -> priority -> aggregates.

Nothing is collected: every stage is a DataFrame, and callers pick the
stage they need (``ScanPlan`` attributes are built lazily on access).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as ctx_ops
from ..operators import metrics, secrets, triage
from ..schemas import FINDINGS

ALL_SCANNERS = ("sast", "sca", "secrets", "iac")


class ScanPlan:
    """Lazy handles on each stage of a corpus scan.

    ``files``: (project, path, content). ``advisories``: nested advisory
    table (needed by the dependency scanner). ``scanners`` / ``quick``
    prune whole branches before the union, as the reference does.
    ``sca``: the dependency findings, where others than all are asked for.
    """

    def __init__(self, files: DataFrame, advisories: DataFrame | None = None,
                 scanners=ALL_SCANNERS, quick: bool = False, include_ref_dead: bool = False,
                 context: DataFrame | None = None, stage_as: str | None = None, sca: DataFrame | None = None):
        self.files = files
        self._sca = sca
        self._context = context
        self.stage_as = stage_as
        self.advisories = advisories
        enabled = set(scanners)
        if quick:
            enabled -= {"sast", "iac"}
        self.enabled = enabled
        self.include_ref_dead = include_ref_dead

    # -- detectors -------------------------------------------------------
    def _detector_outputs(self) -> list[DataFrame]:
        out = []
        if "sast" in self.enabled:
            from ..operators import code
            out.append(code.code_findings(self.files, include_ref_dead=self.include_ref_dead))
        if "sca" in self.enabled and self.advisories is not None:
            out.append(self.sca_findings)
        if "secrets" in self.enabled:
            out.append(secrets.secret_findings(self.files))
        if "iac" in self.enabled:
            from ..operators import config
            out.append(config.config_findings(self.files))
        return out

    @cached_property
    def sca_findings(self) -> DataFrame:
        if self._sca is not None:
            return self._sca
        from ..operators import deps, reach
        pk = deps.packages_from_manifests(self.files)
        return deps.sca_findings(reach.package_reachability(pk, self.files), self.advisories)

    @cached_property
    def detected(self) -> DataFrame:
        """The findings of all detectors, as a plan: nothing runs yet."""
        parts = self._detector_outputs()
        if not parts:
            return self.files.sparkSession.createDataFrame([], FINDINGS)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def detected_counts(self) -> DataFrame:
        """(project, scanner, n) of ``detected``. Dependency findings are counted by package version, which then meets the
        projects and their imports, without a row for each finding."""
        from ..operators import deps, reach
        rest = ScanPlan(self.files, None, scanners=self.enabled, include_ref_dead=self.include_ref_dead)
        out = rest.detected.groupBy("project", "scanner").agg(F.count(F.lit(1)).alias("n"))
        if "sca" not in self.enabled or self.advisories is None:
            return out
        sca = deps.project_counts(deps.packages_from_manifests(self.files), self.advisories)
        sca = reach.apply_reachability(sca, self.files)
        return out.unionByName(sca.groupBy("project", F.lit("sca").alias("scanner")).agg(F.sum("n").alias("n")))

    @cached_property
    def raw_findings(self) -> DataFrame:
        out = self.detected
        if self.stage_as:
            # The raw findings are read twice by dedup (flags and groups):
            # write them once as a table in the shared checkpoint folder
            # (lineage cut at a durable table) instead of recomputing every
            # detector for each branch.
            from ..session import checkpoint_table
            out = checkpoint_table(self.files.sparkSession, out, self.stage_as)
        return out

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        """A written table of what a plan reads many times, where this one stages at all."""
        if not self.stage_as:
            return df
        from ..session import checkpoint_table
        return checkpoint_table(self.files.sparkSession, df, f"{self.stage_as}-{name}")

    # -- triage ----------------------------------------------------------
    @cached_property
    def context(self) -> DataFrame:
        """Per-project context; pass a stored table (``context=``) so the
        planner knows its size, otherwise it is derived from ``files``."""
        if self._context is not None:
            return self._context
        ctx = ctx_ops.project_context(self.files)
        if self.stage_as:
            # a written table: the planner then knows its exact size and
            # broadcasts it only when small (no skewed shuffle on project)
            from ..session import checkpoint_table
            ctx = checkpoint_table(self.files.sparkSession, ctx, self.stage_as + "-context")
        return ctx

    @cached_property
    def contextual(self) -> DataFrame:
        return triage.apply_context(self.raw_findings, self.context)

    @cached_property
    def triaged(self) -> DataFrame:
        """All findings with auto-ignore and duplicate flags."""
        return triage.dedup_flags(self.contextual)

    @cached_property
    def prioritized(self) -> DataFrame:
        return triage.prioritize(self.triaged)

    # -- aggregates ------------------------------------------------------
    def scores(self) -> DataFrame:
        return metrics.security_scores(self.triaged)

    def _triaged_counts(self) -> DataFrame:
        """``triaged`` as far as a summary reads it, each row standing for ``n`` findings: dependency findings whose duplicates
        are known by package version are counted there, all others are triaged one by one."""
        cols = ["project", "severity", "contextual_severity", "auto_ignored", "is_duplicate", "n"]
        if "sca" not in self.enabled or self.advisories is None or self._sca is not None:
            return self.triaged.withColumn("n", F.lit(1)).select(*cols)
        from ..operators import deps, reach
        pk = reach.package_reachability(deps.packages_from_manifests(self.files), self.files)
        counts, rows = deps.sca_decided(pk.drop("reachability_reason"), self.advisories, self._stage)
        rest = ScanPlan(self.files, self.advisories, scanners=self.enabled, include_ref_dead=self.include_ref_dead,
                        context=self.context, stage_as=self.stage_as, sca=rows)
        return rest._triaged_counts().unionByName(triage.apply_context(counts, self.context).select(*cols))

    def summary(self) -> DataFrame:
        """One row per project: the scan result numbers."""
        from ..sources.files import counted_source_files
        projects = self.files.select("project").distinct()
        fcount = counted_source_files(self.files).groupBy("project").agg(
            F.count(F.lit(1)).alias("files_scanned"))
        count = metrics.weighted("n")
        tri = self._triaged_counts().groupBy("project").agg(
            F.sum("n").alias("raw_findings"),
            count(metrics.is_active()).alias("active_findings"),
            count(F.coalesce(F.col("auto_ignored"), F.lit(False))).alias("auto_ignored"),
            *metrics.severity_count_aggs(count=count))
        from ..operators import deps
        dep_count = deps.dependencies_checked(self.files)
        j = (projects.join(fcount, "project", "left").join(tri, "project", "left")
             .join(dep_count, "project", "left").na.fill(0))
        j = j.withColumn("noise_reduction_percent",
                         metrics.noise_reduction(F.col("raw_findings"), F.col("active_findings")))
        return metrics.with_score(j).select(
            "project", F.col("files_scanned").cast("long"), F.col("dependencies_checked").cast("long"),
            F.col("raw_findings").cast("long"), F.col("active_findings").cast("long"),
            F.col("auto_ignored").cast("long"), "noise_reduction_percent", "security_score", "grade")
