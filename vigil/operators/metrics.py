"""Per-project aggregates: severity counts, score, grade, gates, summaries.

All are single ``groupBy`` aggregates with conditional counts (partial
aggregation map-side, one shuffle on ``project``), never a collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, effective_severity, grade, half_up, score_band, security_score


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_active() -> Column:
    return ~_truthy(F.col("auto_ignored")) & ~_truthy(F.col("is_duplicate"))


def severity_count_aggs(prefix: str = "", count=F.count_if) -> list[Column]:
    eff = effective_severity()
    return [count(is_active() & (eff == s)).cast("long").alias(f"{prefix}{s}") for s in SEVERITIES]


def weighted(n: str):
    """``count_if`` over rows that stand for ``n`` findings each."""
    return lambda c: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))


def severity_counts(triaged: DataFrame, keys=("project",)) -> DataFrame:
    """Active findings per effective severity; all five columns present."""
    return triaged.groupBy(*keys).agg(*severity_count_aggs(),
                                      F.count_if(is_active()).cast("long").alias("total"))


def with_score(counts: DataFrame) -> DataFrame:
    s = security_score(*SEVERITIES)
    return (counts.withColumn("security_score", s)
            .withColumn("grade", grade("security_score"))
            .withColumn("score_band", score_band("security_score")))


def security_scores(triaged: DataFrame, keys=("project",)) -> DataFrame:
    return with_score(severity_counts(triaged, keys))


def report_scores(triaged: DataFrame) -> DataFrame:
    """``security_scores`` with what a report says about noise, in the same aggregate."""
    counts = triaged.groupBy("project").agg(
        *severity_count_aggs(), F.count_if(is_active()).cast("long").alias("total"),
        F.count(F.lit(1)).alias("raw_findings"), F.count_if(_truthy(F.col("auto_ignored"))).alias("auto_ignored"))
    return with_score(counts).withColumn("noise_reduction_percent", noise_reduction(F.col("raw_findings"), F.col("total")))


def ci_gate(triaged: DataFrame, fail_on=("critical", "high")) -> DataFrame:
    """Per project: pass / fail when any active finding has a listed severity."""
    eff = effective_severity()
    agg = triaged.groupBy("project").agg(
        *[F.count_if(is_active() & (eff == s)).cast("long").alias(s) for s in ("critical", "high")],
        F.count_if(is_active() & eff.isin(list(fail_on))).cast("long").alias("failing"))
    return agg.withColumn("gate", F.when(F.col("failing") > 0, "fail").otherwise("pass"))


def auto_ignored_summary(triaged: DataFrame) -> DataFrame:
    return (triaged.where(_truthy(F.col("auto_ignored")))
            .groupBy("project", "auto_ignore_reason").agg(F.count(F.lit(1)).alias("n")))


def scanner_breakdown(triaged: DataFrame) -> DataFrame:
    return (triaged.where(is_active()).groupBy("project", "scanner")
            .agg(F.count(F.lit(1)).alias("n")))


def noise_reduction(raw_count: Column, active_count: Column) -> Column:
    return F.when(raw_count > 0, half_up((raw_count - active_count).cast("double") / raw_count * 100)) \
        .otherwise(0).cast("int")
