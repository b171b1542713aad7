"""Spark queries vs the DuckDB oracle SQL on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["scan_secrets_score", "scan_result", "secret_findings", "sast_findings", "iac_findings", "sca_findings",
        "reachability", "project_context", "triage_context", "dedup_flags", "priority_score", "severity_counts",
        "top_n_console", "trend", "status_diff", "sink_markdown", "env_validate", "dep_health", "src_last_scan"]


@pytest.fixture(scope="module")
def con():
    from check_oracle import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    import __spark_entry__ as E
    from check_oracle import digest
    df = E.queries()[key](spark, SF)
    rows, cols = df.collect(), df.columns
    res = con.sql(E.oracle_sql()[key])
    orows, ocols = res.fetchall(), res.columns
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "security_score" in df.columns
