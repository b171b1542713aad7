"""Query registry: key -> (Spark DataFrame builder, DuckDB oracle SQL).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
driver tables (or tables Spark derives from them). Each oracle SQL answers
the same question in DuckDB over the same parquet views; columns are
aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: Callable[[], str] | None
    section: str = ""


REGISTRY: dict[str, Query] = {}


def query(key: str, section: str = "", oracle: Callable[[], str] | None = None):
    def deco(fn):
        REGISTRY[key] = Query(key, fn, oracle, section)
        return fn
    return deco


MODULES = ("q_core", "q_detect", "q_triage")


def load_all() -> dict[str, Query]:
    """Import the query modules (registering their queries) and attach
    each module's ORACLE entries to its queries."""
    import importlib
    for mod in MODULES:
        m = importlib.import_module(f"{__package__}.{mod}")
        for key, sql in getattr(m, "ORACLE", {}).items():
            if key in REGISTRY:
                REGISTRY[key].oracle = sql
    return REGISTRY
