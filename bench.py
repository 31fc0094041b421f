"""Headline timings as one JSON line.

``build_tables`` is the single pass over the line items plus the small market tables and
landing files. Every number is the better of two runs with a full result (all rows, all
columns), so that it measures the engine and not the start of the JVM.

``by_supplier`` repeats the dearest plans over bars per supplier: their number grows with the
tables, while bars per brand end at 25 series. They are not part of the total.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.operators.rolling import rolling_indicators
from barscreen.operators.upsert import upsert
from barscreen.plans import metrics, screens
from barscreen.session import clear
from workload import tables
from workload.queries import QUERIES

HEADLINES = (
    "screen_volume_breakout", "screen_upward_breakout", "screen_downward_breakout",
    "screen_volume_breakout_delivery", "screen_upward_breakout_delivery",
    "screen_downward_breakout_delivery", "screen_relative_weakness", "screen_latest",
    "screen_counts", "screen_ban_marked", "rolling_indicators", "stock_metrics",
    "stock_list_page", "sparkline", "stock_history", "ban_frequency", "market_stats",
    "detect_jumps_abs", "dq_summary", "repair_update", "clean_bars", "upsert_bars",
    "incremental_append", "metadata_update", "lot_sizes_json", "stream_upsert",
)


def best_of_two(run: Callable[[], None]) -> float:
    seconds = []
    for _ in range(2):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return min(seconds)


def supplier_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    bars, index = tables.bars(spark, sf_dir, "supplier"), tables.index(spark, sf_dir)
    last_year = bars.filter(F.col("date") >= F.lit("2000-01-01").cast("date"))
    return {
        "rolling_indicators": rolling_indicators(bars),
        "screen_upward_breakout": screens.screen(bars, "upward-breakout", as_of=None),
        "screen_upward_breakout_latest": screens.screen(bars, "upward-breakout"),
        "stock_metrics": metrics.stock_metrics(bars, index, benchmark=tables.BENCHMARK),
        "upsert_bars": upsert(bars, last_year, ["symbol", "date"]),
    }


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barscreen-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a third of the time to build a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def build_tables() -> None:
        tables.forget()
        for build in (
            tables.daily, tables.index, tables.master, tables.equity_landing,
            tables.adjusted_landing, tables.metadata_landing,
        ):
            build(spark, sf_dir)

    def run_query(name: str) -> None:
        run(QUERIES[name](spark, sf_dir))

    seconds = {"build_tables": best_of_two(build_tables)}
    for name in HEADLINES:
        seconds[name] = best_of_two(lambda: run_query(name))
    supplier = {
        name: round(best_of_two(lambda df=df: run(df)), 3)
        for name, df in supplier_frames(spark, sf_dir).items()
    }
    rows = tables.bars(spark, sf_dir, "supplier").count()
    clear(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "by_supplier": {"rows": rows, **supplier},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
