"""Headline-query benchmark.

Runs the main queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line.  Every query is executed in
full through the ``noop`` sink (no driver collection), after one untimed
warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerscope.session import get_session  # noqa: E402
from ledgerscope.plans.registry import queries  # noqa: E402

HEADLINE = [
    "fraud_score",            # six rules + composite score (flagship)
    "engineer_features",      # twelve model features
    "per_rule_report",        # evaluation tables
    "roc_auc",
    "describe_features",      # exact quartiles of twelve features
    "generic_pipeline",       # forest + exact kNN / DBSCAN noise / LOF + vote on `part`
    "boosted_trees_scores",   # weighted GBT, 200 rounds, fit + score
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, extra={
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.local.dir": os.path.join(scratch, "local"),
    })
    qs = queries()
    qs["fraud_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
