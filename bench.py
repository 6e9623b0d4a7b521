"""Headline timings: the whole pipeline, then stage by stage, each on fresh stage tables; one JSON line at the end."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stockweave.operators import daily as D  # noqa: E402
from stockweave.operators import orders as O  # noqa: E402
from stockweave.operators import risk as R  # noqa: E402
from stockweave.plans.pipeline import ALL_MODELS, NAIVE_MODELS, Pipeline  # noqa: E402

CORES = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CORES}]").appName("stockweave-bench")
        .config("spark.sql.shuffle.partitions", CORES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Compute every column of every row without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # start the engine
    r = Pipeline(spark, SF_DIR, models=ALL_MODELS)
    light = Pipeline(spark, SF_DIR, models=NAIVE_MODELS)
    # 125 series x 357 weeks: close in size to the published run of 328 series x 107 weeks
    dense = Pipeline(spark, SF_DIR, models=ALL_MODELS, grain="brand_region")
    whole = Pipeline(spark, SF_DIR, models=ALL_MODELS)
    steps: dict[str, Callable[[], object]] = {
        "full_pipeline_125_series": dense.run,
        "full_pipeline_18_series": whole.run,
        "prepare_sell_out": r.sell_out,
        "prepare_inventory": lambda: (r.stores(), r.inventory(), r.inventory_cedis()),
        "prepare_daily": r.daily,
        "prepare_weekly": lambda: (r.weekly(), r.series()),
        "outliers": lambda: run(D.flag_outliers(D.complete_daily_calendar(r.sell_out(), r.last_sale()), 5.0)),
        "backtest_all_models": r.backtest,
        "metrics_and_selection": lambda: (r.metrics(), r.selection(), r.calibration(), r.holdout()),
        "blind_test": lambda: (r.blind_metrics(), r.blind_regret()),
        "forecast": r.forecast,
        "risk": lambda: (r.labeled(), r.method_metrics(), run(R.threshold_sweep(r.labeled())), run(R.lead_time_table(r.labeled())), r.alerts()),
        "orders": lambda: (run(O.order_file(r.orders())), r.order_summary()),
        "scorecard": r.scorecard,
        "naive_models_to_orders": light.orders,
    }
    times: dict[str, float] = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "full_pipeline_wall_clock", "value": times["full_pipeline_125_series"], "unit": "sec", "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
