"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans import QUERIES  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = [
    "daily_bars",
    "quality_report",
    "returns",
    "rsi",
    "macd",
    "feature_panel",
    "cross_sectional",
    "market_state",
    "asof_inclusive",
    "flow_features",
    "delivery_features",
    "option_features",
    "intraday_features",
    "daily_sentiment",
    "earnings_features",
    "classification_metrics",
    "metrics_by_period",
    "threshold_sweep",
    "weights_hysteresis",
    "portfolio_summary",
    "cost_sensitivity",
    "long_short_summary",
    "score_cards",
    "stream_candles",
    "latest_model_signal",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["freshness"](spark, folder).collect()  # starts the JVM side: readers, code generation
    seconds = {}
    runs = int(os.environ.get("BENCH_RUNS", "2"))  # the first run pays code generation, the best is reported
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    found = re.search(r"sf([0-9.]+)", folder)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "runs": runs, "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
