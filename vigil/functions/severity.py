"""Severity, score and grade expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
SCORE_DEDUCTION = {"critical": 20.0, "high": 10.0, "medium": 3.0, "low": 1.0, "info": 0.5}
GRADE_FLOORS = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")]  # else F
SCORE_BANDS = [(80, "good"), (60, "fair"), (40, "poor")]  # else critical


def _lookup(col: Column, table: dict, default=None) -> Column:
    expr = None
    for key, value in table.items():
        expr = (F.when(col == key, F.lit(value)) if expr is None
                else expr.when(col == key, F.lit(value)))
    return expr.otherwise(F.lit(default))


def severity_rank(col) -> Column:
    """critical 5 ... info 1, anything else 0."""
    return _lookup(F.col(col) if isinstance(col, str) else col, SEVERITY_RANK, 0)


def confidence_rank(col) -> Column:
    return _lookup(F.col(col) if isinstance(col, str) else col, CONFIDENCE_RANK, 0)


def effective_severity(contextual="contextual_severity", severity="severity") -> Column:
    """Contextual severity when set (and non-empty), else the original."""
    ctx = F.col(contextual) if isinstance(contextual, str) else contextual
    sev = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(F.nullif(ctx, F.lit("")), sev)


def half_up(x: Column) -> Column:
    """JavaScript Math.round: half rounds toward +infinity."""
    return F.floor(x + F.lit(0.5))


def grade(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for floor_, letter in GRADE_FLOORS:
        expr = (F.when(s >= floor_, letter) if expr is None
                else expr.when(s >= floor_, letter))
    return expr.otherwise("F")


def score_band(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for floor_, band in SCORE_BANDS:
        expr = (F.when(s >= floor_, band) if expr is None
                else expr.when(s >= floor_, band))
    return expr.otherwise("critical")


def security_score(critical, high, medium, low, info) -> Column:
    """100 minus weighted deductions, clamped to 0..100, rounded half up."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (critical, high, medium, low, info)]
    deductions = (cols[0] * SCORE_DEDUCTION["critical"] + cols[1] * SCORE_DEDUCTION["high"]
                  + cols[2] * SCORE_DEDUCTION["medium"] + cols[3] * SCORE_DEDUCTION["low"]
                  + cols[4] * SCORE_DEDUCTION["info"])
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - deductions))
    return half_up(raw).cast("int")
