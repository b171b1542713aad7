"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf", ...}.
Each query runs to completion through the ``noop`` sink (full execution,
nothing collected to the driver). The derived corpus tables are staged
once before timing (reported as ``setup_sec``), as a real deployment would
read them from storage.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_result",        # flagship: all detectors -> reachability -> triage -> scores
    "secret_findings",
    "sast_findings",
    "iac_findings",
    "sca_findings",
    "reachability",
    "dedup_flags",
    "priority_score",
    "severity_counts",
    "top_n_console",
    "trend",
    "status_diff",
    "sink_markdown",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    from vigil.plans.q_core import corpus_of
    from vigil.plans.queries import load_all
    from vigil.session import local_session

    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus * 2)))
    spark = local_session(cpus, shuffle_partitions=shuffle, app="vigil-bench")
    reg = load_all()
    t0 = time.time()
    c = corpus_of(spark, sf_dir)
    for t in ("files", "advisories", "findings", "context"):
        getattr(c, t).count()
    setup = time.time() - t0
    times = {}
    for key in (only or HEADLINE):
        t = time.time()   # build included: some plans stage a table while building
        df = reg[key].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
        "setup_sec": round(setup, 3), "n_queries_registered": len(reg),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
