"""Backtest over many origins at once, interval calibration, model selection and the blind test."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.metrics import weighted_mean
from stockweave.functions.quantiles import finalize, grouped_quantiles, join_groups
from stockweave.models.future import FOLD_KEY, eligible_series, with_folds
from stockweave.params import SERIES

# Simpler models first: ties in the selection resolve toward the earlier entry.
MODEL_ORDER = ("ma4", "seasonal_naive", "ets", "gbt")
FALLBACK_MODEL = "ma4"

# Fixed values: (lower, upper, nominal level) of the two calibrated intervals and the floor of the factor.
INTERVALS = (("q10", "q90", 0.90 - 0.10), ("q05", "q95", 0.95 - 0.05))
MIN_FACTOR = -0.4

# The groupings the backtest reports.
LEVELS_REPORTED = {
    "fold": ("model", "cluster", "fold"),
    "cluster": ("model", "cluster"),
    "cluster_h": ("model", "cluster", "h"),
    "overall": ("model",),
    "cedis": ("model", "cedis"),
}

Model = Callable[[DataFrame, Sequence[date]], DataFrame]


def union_models(predictions: Sequence[DataFrame]) -> DataFrame:
    out = predictions[0]
    for p in predictions[1:]:
        out = out.unionByName(p)
    return out


def attach_actuals(pred: DataFrame, weekly: DataFrame) -> DataFrame:
    actual = weekly.select(*SERIES, F.col("week_start").alias("target_week"), "y", "cluster")
    return pred.join(actual, [*SERIES, "target_week"], "left")


def run_backtest(weekly: DataFrame, models: Sequence[Model], origins: Sequence[date], min_weeks: int) -> DataFrame:
    """Every model at every origin for the series with enough history there, with the actuals."""
    eligible = eligible_series(with_folds(weekly.select(*SERIES, "week_start", "y"), origins), min_weeks)
    pred = union_models([m(weekly, origins) for m in models])
    return attach_actuals(pred.join(eligible.select(*FOLD_KEY), list(FOLD_KEY), "left_semi"), weekly)


def calibrate_intervals(pred: DataFrame) -> DataFrame:
    """Width factor per (model, cluster, interval): the nominal quantile of the scaled miss distance."""
    rows = pred.filter(F.col("y").isNotNull())
    for lo, hi, _ in INTERVALS:
        width = F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6))
        rows = rows.withColumn(f"e_{lo}", F.greatest(F.col(lo) - F.col("y"), F.col("y") - F.col(hi)) / width)
    key = ["model", "cluster"]
    factors = grouped_quantiles(rows, key, {f"k_{lo}": (f"e_{lo}", nominal) for lo, _, nominal in INTERVALS})
    table = join_groups(factors, rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    kinds = F.array(*[
        F.struct(
            F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(nominal).alias("nominal"),
            F.greatest(F.col(f"k_{lo}"), F.lit(MIN_FACTOR)).alias("k"),
        )
        for lo, hi, nominal in INTERVALS
    ])
    return table.select(*key, "n", F.explode(kinds).alias("i")).select(*key, "i.*", "n")


def apply_calibration(pred: DataFrame, calibration: DataFrame) -> DataFrame:
    """Shift the bounds by k widths, then clip and sort the row again."""
    per_pair = calibration.groupBy("model", "cluster").agg(
        *[F.max(F.when(F.col("lo") == lo, F.col("k"))).alias(f"k_{lo}") for lo, _, _ in INTERVALS]
    )
    # one row per model and ABC-XYZ cluster: a few dozen at most
    out = pred.join(F.broadcast(per_pair), ["model", "cluster"], "left")
    for lo, hi, _ in INTERVALS:
        shift = F.coalesce(f"k_{lo}", F.lit(0.0)) * F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6))
        out = out.withColumn("_shift", shift).withColumn(lo, F.col(lo) - F.col("_shift")).withColumn(hi, F.col(hi) + F.col("_shift"))
    return finalize(out.drop("_shift", *[f"k_{lo}" for lo, _, _ in INTERVALS]))


def select_models(metrics_fold: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One model per cluster: steadiest, then simplest, among those within ``tolerance`` of the best mean WAPE."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    table = metrics_fold.groupBy("cluster", "model").agg(
        F.avg("wape").alias("wape_mean"), F.stddev_samp("wape").alias("wape_std"), F.avg("bias").alias("bias_mean"), F.avg("coverage_90").alias("coverage_90")
    )
    within = table.withColumn("best_wape", F.min("wape_mean").over(Window.partitionBy("cluster"))).filter(
        F.col("wape_mean") <= F.col("best_wape") + tolerance
    )
    order = Window.partitionBy("cluster").orderBy(F.col("wape_std").asc_nulls_last(), rank)
    why = F.when(F.col("wape_mean") == F.col("best_wape"), "lowest mean WAPE").otherwise(
        F.format_string(f"within {tolerance:.2f} WAPE of best (%.3f) with lower fold spread", F.col("best_wape"))
    )
    return within.withColumn("_pick", F.row_number().over(order)).filter("_pick = 1").select(
        "cluster", F.col("model").alias("selected_model"), "wape_mean", "wape_std", "bias_mean", "coverage_90", "best_wape", why.alias("rationale")
    )


def raw_and_calibrated(pred: DataFrame, calibration: DataFrame) -> DataFrame:
    """Every row twice, as predicted and with calibrated intervals; column ``quantiles`` tells which."""
    return pred.withColumn("quantiles", F.lit("raw")).unionByName(
        apply_calibration(pred, calibration).withColumn("quantiles", F.lit("calibrated"))
    )


# ------------------------------------------------------------------ blind test
def split_folds(pred: DataFrame, horizon: int) -> DataFrame:
    """(fold, origin, role): the last fold is sealed; folds whose targets end by its origin are usable."""
    folds = pred.groupBy("fold").agg(F.min("origin").alias("origin"))
    last = folds.agg(F.max(F.struct("fold", "origin"))).scalar()
    role = F.when(F.col("fold") == last["fold"], "sealed").when(F.date_add("origin", 7 * horizon) <= last["origin"], "usable").otherwise("overlap")
    return folds.withColumn("role", role)


def folds_with_role(pred: DataFrame, horizon: int, role: str) -> DataFrame:
    # one row per fold: a handful
    return pred.join(F.broadcast(split_folds(pred, horizon).filter(F.col("role") == role).select("fold")), "fold", "left_semi")


def blind_overall(metrics: DataFrame) -> DataFrame:
    """Calibrated metrics per model next to the raw coverage, from metrics by (quantiles, model)."""
    raw = metrics.filter("quantiles = 'raw'").select(
        "model", F.col("coverage_90").alias("coverage_90_raw"), F.col("coverage_80").alias("coverage_80_raw")
    )
    return metrics.filter("quantiles = 'calibrated'").drop("quantiles").join(raw, "model").orderBy("wape", "model")


def blind_regret(cluster_metrics: DataFrame, preselection: DataFrame) -> DataFrame:
    """Pre-registered choice against the best model in hindsight, per cluster."""
    best = cluster_metrics.groupBy("cluster").agg(F.min(F.struct("wape", "model")).alias("b"))
    chosen = cluster_metrics.join(
        preselection.select("cluster", F.col("selected_model").alias("model")), ["cluster", "model"]
    )
    return chosen.join(best, "cluster").select(
        "cluster",
        F.col("model").alias("pre_registered_model"),
        F.col("wape").alias("blind_wape_pre_registered"),
        F.col("b.model").alias("best_model_in_hindsight"),
        F.col("b.wape").alias("blind_wape_best"),
        (F.col("wape") - F.col("b.wape")).alias("regret"),
        F.col("coverage_90").alias("coverage_90_pre_registered"),
        "n",
        (F.col("model") == F.col("b.model")).alias("choice_held"),
    )


def blind_weighted(regret: DataFrame) -> DataFrame:
    return regret.agg(
        weighted_mean("blind_wape_pre_registered").alias("blind_wape"), weighted_mean("blind_wape_best").alias("blind_wape_best")
    )
