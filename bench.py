"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barspan.plans.registry import load_all
from barspan.session import ensure_shared_folder, local_session

HEADLINE = [
    "s1_read_panel",
    "f1_clean_bars",
    "f5_clean_report",
    "w3_moving_averages",
    "w5_macd",
    "w13_volatility",
    "w22_candle_shapes",
    "w23_range_family",
    "w24_cross_section",
    "w32_market_context",
    "w36_full_ranking",
    "a6_descriptive_statistics",
    "a13_resample_week",
    "a19_ranking_metrics",
    "q5_source_attribution",
    "q7_gap_plan",
    "t1_parse_and_validate",
    "t4_indicator_values",
    "t6_batch_twin",
    "b1_signal_backtest",
    "b2_portfolio_equity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(spark)
    queries, _ = load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM's readers
    spent = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
