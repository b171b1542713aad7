"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic; a cell's mass is its
tokens. Each margin has target shares. Raking multiplies, margin by margin,
the cells' weights by target share / present share until all margins agree.
The cells stay a Spark table; a sweep brings only one sum for each category to
the driver, and categories are those that the targets name (at most
``MAX_CATEGORIES`` a margin, else an error). The weights over the masses give
each cell's sampling rate: rates are scaled to a token budget, none above 1
(what a full cell cannot give, the others do), and a document stays if a
number drawn from its id is below its cell's rate.

Defined results: null source, language or topic is a category of its own. A
category with a target but no tokens is left out and the others take its
share. A text without words has one token's mass (its end). Rows that repeat
an id share one fate. An empty table gives an empty sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import col, staged, uniform

MARGINS = ("source", "lang", "topic")
MAX_CATEGORIES, SWEEPS, NEAR, GRID = 10_000, 20, 1e-4, 64
NONE = "\x00none"


def words_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def topic_of(text_col: str) -> Column:
    """A text's form, as its topic: tables, lists of lines, short, middle or long prose."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    size = F.length(text)
    bars = F.regexp_count(text, F.lit(r" \| "))
    lines = F.regexp_count(text, F.lit("\n"))
    return (F.when(bars * 60 > size, "table").when(lines * 80 > size, "lines").when(size < 600, "short")
            .when(size < 4000, "middle").otherwise("long"))


def flattened(masses: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to a power of the masses: below 1 it lifts small categories."""
    raised = {c: m ** power for c, m in masses.items() if m > 0}
    total = sum(raised.values())
    return {c: m / total for c, m in raised.items()}


def _table(name: str, values: dict[str, float], df: DataFrame) -> DataFrame:
    """A category's factor, as a table to broadcast: at most MAX_CATEGORIES rows."""
    return F.broadcast(df.sparkSession.createDataFrame(list(values.items()), f"{name} string, `f_{name}` double"))


def _sums(cells: DataFrame, name: str, weight: Column) -> dict[str, float]:
    rows = cells.groupBy(name).agg(F.sum(weight).alias("w")).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{name} has more than {MAX_CATEGORIES} categories; fold the rare ones first")
    return {r[0]: float(r[1] or 0.0) for r in rows}


def rake(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """``cells`` (one row a cell: the margins and ``mass``) with ``weight``, raked to the targets."""
    factors: dict[str, dict[str, float]] = {m: dict.fromkeys(targets[m], 1.0) for m in MARGINS}

    def weighted() -> DataFrame:
        out = reduce(lambda d, m: d.join(_table(m, factors[m], cells), m, "left"), MARGINS, cells)
        product = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"f_{m}"), F.lit(0.0)) for m in MARGINS])
        return out.withColumn("weight", F.col("mass") * product)

    for _ in range(SWEEPS):
        worst = 0.0
        for m in MARGINS:
            now = _sums(weighted(), m, F.col("weight"))
            there = {c: s for c, s in now.items() if s > 0 and targets[m].get(c, 0) > 0}
            share, total = sum(targets[m][c] for c in there), sum(there.values())
            for c in factors[m]:
                f = targets[m][c] / share / (there[c] / total) if c in there else 1.0
                worst = max(worst, abs(f - 1.0))
                factors[m][c] *= f / total if c in there else 1.0
        if worst < NEAR:
            break
    return weighted().drop(*[f"f_{m}" for m in MARGINS])


def rates(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with ``rate``: weight / mass, scaled so that ``budget`` tokens are expected, none above 1."""
    ratio = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0)
    top, full = cells.agg(F.max(ratio), F.sum(F.when(ratio > 0, F.col("mass")))).first()
    if not top:
        return cells.withColumn("rate", F.lit(0.0))
    least = cells.where(ratio > 0).agg(F.min(ratio)).first()[0]
    low, high = 0.0, 1.0 / least  # at the upper end every cell gives all
    if budget >= full:
        low = high
    for _ in range(6 if budget < full else 0):  # each round narrows the scale 64-fold
        grid = [low + (high - low) * (i + 1) / GRID for i in range(GRID)]
        sums = cells.agg(*[F.sum(F.least(F.lit(1.0), ratio * g) * F.col("mass")) for g in grid]).first()
        at = next((i for i, s in enumerate(sums) if s >= budget), GRID - 1)
        low, high = (grid[at - 1] if at else low), grid[at]
    scale = high if budget < full else low
    return cells.withColumn("rate", F.least(F.lit(1.0), ratio * F.lit(scale)))


def marked(df: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None = None) -> DataFrame:
    """``df`` with __source, __lang, __topic and __mass."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return df.withColumns({"__source": named(col(source_col)), "__lang": named(col(lang_col)),
                           "__topic": named(topic if topic is not None else topic_of(text_col)),
                           "__mass": (words_of(text_col) + 1).cast("long")})


def plan_mix(df: DataFrame, budget_share: float = 0.5, targets: dict[str, dict[str, float]] | None = None,
             source_power: float = 0.5, lang_power: float = 0.7, topic_power: float = 1.0) -> DataFrame:
    """Cells with mass, weight and rate. Targets default to flattened shares of the corpus."""
    cells = staged(df.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS])
                   .agg(F.sum("__mass").alias("mass"), F.count("*").alias("documents")), "cells")
    powers = dict(zip(MARGINS, (source_power, lang_power, topic_power), strict=True))
    goals = {m: (targets or {}).get(m) or flattened(_sums(cells, m, F.col("mass")), powers[m]) for m in MARGINS}
    total = cells.agg(F.sum("mass")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0)).withColumn("rate", F.lit(0.0))
    return staged(rates(staged(rake(cells, goals), "raked"), budget_share * total), "rates")


def with_rate(df: DataFrame, cells: DataFrame) -> DataFrame:
    """``df`` (marked) with its cell's __rate. Cells are broadcast up to a counted size."""
    few = cells.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("rate").alias("__rate"))
    return df.join(F.broadcast(few) if cells.count() <= MAX_CATEGORIES else few, [f"__{m}" for m in MARGINS], "left")


def sample_mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
               lang_col: str = "lang", budget_share: float = 0.5, seed: str = "mix") -> DataFrame:
    """``df`` with __source, __lang, __topic, __mass, __rate and __chosen."""
    own = marked(df, text_col, source_col, lang_col)
    cells = plan_mix(own.select("__source", "__lang", "__topic", "__mass"), budget_share)
    return with_rate(own, cells).withColumn("__chosen", uniform(id_col, seed) < F.col("__rate"))
