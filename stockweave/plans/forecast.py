"""Production forecasts at one or more origins with the selected model per series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.models.future import FOLD_KEY, eligible_series, with_folds
from stockweave.params import SERIES
from stockweave.plans.backtest import FALLBACK_MODEL, Model, apply_calibration, union_models


def forecast_at_origins(weekly: DataFrame, models: Sequence[Model], origins: dict[str, date]) -> DataFrame:
    """All models for every series at the named origins, with the history length at each."""
    labels, dates = list(origins), list(origins.values())
    history = eligible_series(with_folds(weekly.select(*SERIES, "week_start", "y"), dates), 1)
    pred = union_models([m(weekly, dates) for m in models]).join(history, list(FOLD_KEY), "left")
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("fold") + 1)
    return pred.withColumn("origin_label", name).drop("fold")


def apply_selection(pred: DataFrame, selection: DataFrame, series: DataFrame, cold_start_weeks: int) -> DataFrame:
    """Rows of the model chosen for the series' cluster; short histories, and rows the model has no value for, take the fallback."""
    facts = series.select(*SERIES, "is_discontinued", "is_high_promo")
    # one row per ABC-XYZ cluster
    chosen = pred.join(F.broadcast(selection.select("cluster", "selected_model")), "cluster", "left").join(facts, list(SERIES), "left")
    cold = F.coalesce("n_weeks_at_origin", F.lit(0)) < cold_start_weeks
    pick = F.when(cold, FALLBACK_MODEL).otherwise(F.coalesce("selected_model", F.lit(FALLBACK_MODEL)))
    # of the pick and the fallback: the pick with a value, the fallback, the pick without one
    rank = F.when(F.col("model") != pick, 1).when(F.col("q50").isNull(), 2).otherwise(0)
    rows = chosen.withColumns({"is_cold_start": cold, "_rank": rank}).filter(F.col("model").isin(FALLBACK_MODEL) | (F.col("model") == pick))
    one = Window.partitionBy(*SERIES, "origin_label", "h").orderBy("_rank")
    return rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("selected_model", "_rank", "_n")


def calibrated_forecast(pred: DataFrame, series: DataFrame, calibration: DataFrame) -> DataFrame:
    return apply_calibration(pred.join(series.select(*SERIES, "cluster"), list(SERIES), "left"), calibration)
