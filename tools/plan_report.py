"""Summarise the physical plans of registered queries: exchanges (shuffles),
broadcasts, sorts, window operators, scans and the columns they read.

usage: python tools/plan_report.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.plans import all_queries  # noqa: E402
from panelcast.session import build_session  # noqa: E402

DEFAULT = ["feature_flagship", "feature_build_default", "prediction_features", "ewm", "describe_lineitem",
           "outlier_comparison", "time_series_folds"]


def summarise(plan: str) -> dict:
    return {
        "shuffle_exchanges": len(re.findall(r"Exchange (hash|range|Single|round)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "sorts": len(re.findall(r"\bSort \[", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "scans": sorted(set(re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan))),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if not a.startswith("/")] or DEFAULT
    spark = build_session(shuffle_partitions=8)
    for n in names:
        df = all_queries.QUERIES[n](spark, sf)
        df.foreach(lambda _: None)      # run through this Dataset, so AQE shows its final plan
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]   # final AQE plan only
        reused = plan.count("ReusedExchange") + plan.count("ReusedQueryStage")
        s = summarise(plan)
        print(f"{n}: exchanges={s['shuffle_exchanges']} broadcasts={s['broadcasts']} sorts={s['sorts']} "
              f"windows={s['windows']} reused={reused}")
        for cols in s["scans"]:
            print(f"    scan reads [{cols}]")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
