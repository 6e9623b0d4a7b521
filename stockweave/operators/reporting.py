"""Aggregates behind the summary tables and exploratory views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.metrics import weighted_mean
from stockweave.functions.quantiles import grouped_quantiles, join_groups
from stockweave.params import QCOLS, SERIES

NAIVE = ("ma4", "seasonal_naive")
EFFECT_FLAGS = ("is_payday_window", "is_holiday", "is_semana_santa", "is_buen_fin", "is_december_peak")
TIMELINE_ROWS = 30


# ------------------------------------------------------------------ model accuracy
def accuracy_pivot(cluster_metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    return cluster_metrics.groupBy("cluster").pivot("model", list(models)).agg(F.first("wape"))


def calibration_pivot(calibration: DataFrame) -> DataFrame:
    """One row per (model, cluster) with the factor of each nominal level."""
    pick = lambda level: F.max(F.when(F.abs(F.col("nominal") - level) < 1e-6, F.col("k")))
    return calibration.groupBy("model", "cluster").agg(pick(0.8).alias("k_80"), pick(0.9).alias("k_90"))


def selected_rows(metrics: DataFrame, selection: DataFrame) -> DataFrame:
    return metrics.join(selection.select("cluster", F.col("selected_model").alias("model")), ["cluster", "model"])


def best_naive(overall: DataFrame) -> DataFrame:
    naive = overall.filter(F.col("model").isin(*NAIVE) & F.col("wape").isNotNull())
    return naive.agg(F.min(F.struct("wape", "model")).alias("b")).filter("b is not null").select("b.model", "b.wape")


def error_reduction(overall: DataFrame) -> DataFrame:
    base = overall.filter("model = 'ma4'").agg(F.max("wape")).scalar()
    return overall.select("model", (1 - F.col("wape") / base).alias("reduction_vs_ma4"))


def wape_by_horizon(cluster_h: DataFrame) -> DataFrame:
    return cluster_h.groupBy("model", "h").agg(weighted_mean("wape").alias("wape"))


def coverage_by_model(holdout: DataFrame) -> DataFrame:
    return holdout.groupBy("quantiles", "model").agg(weighted_mean("coverage_90").alias("coverage_90"), weighted_mean("coverage_80").alias("coverage_80"))


def cluster_forecast_vs_actual(pred: DataFrame, weekly: DataFrame, selection: DataFrame, weeks: int = 26) -> DataFrame:
    """Cluster totals of the last fold with the selected model, after ``weeks`` weeks of history of the same series."""
    last = pred.agg(F.max(F.struct("fold", "origin"))).scalar()
    rows = selected_rows(pred.filter(F.col("fold") == last["fold"]), selection)
    ahead = rows.groupBy("cluster", F.col("target_week").alias("week_start")).agg(F.sum("y").alias("y"), *[F.sum(q).alias(q) for q in ("q10", "q50", "q90")])
    past = (
        weekly.withColumn("origin", last["origin"])
        .filter((F.col("week_start") > F.date_sub("origin", 7 * weeks)) & (F.col("week_start") <= F.col("origin")))
        .join(rows.select(*SERIES).distinct(), list(SERIES), "left_semi")
        .groupBy("cluster", "week_start").agg(F.sum("y").alias("y"))
    )
    return past.select("cluster", "week_start", "y", *[F.lit(None).cast("double").alias(q) for q in ("q10", "q50", "q90")]).unionByName(ahead)


def _relative_residuals(pred: DataFrame, selection: DataFrame) -> DataFrame:
    return selected_rows(pred.filter("y > 0"), selection).select("cluster", ((F.col("q50") - F.col("y")) / F.col("y")).alias("rel"))


def residual_quantiles(pred: DataFrame, selection: DataFrame) -> DataFrame:
    return grouped_quantiles(_relative_residuals(pred, selection), ["cluster"], {"p10": ("rel", 0.1), "median": ("rel", 0.5), "p90": ("rel", 0.9)})


def residual_histogram(pred: DataFrame, selection: DataFrame, bins: int = 50) -> DataFrame:
    """Counts over equal bins on [-1, 1]; values outside fall into the end bins."""
    clipped = F.least(F.greatest(F.col("rel"), F.lit(-1.0)), F.lit(1.0))
    bin_no = F.least(F.floor((clipped + 1.0) * (bins / 2)), F.lit(bins - 1)).cast("int")
    return _relative_residuals(pred, selection).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ risk
def any_alert(methods: Sequence[str]) -> Column:
    out = F.col(f"alert_{methods[0]}")
    for m in methods[1:]:
        out = out | F.col(f"alert_{m}")
    return out


def alert_activity(labeled: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Event days, alert days and median cover per series; a series has one row per inventory day."""
    return labeled.withColumn("_any", any_alert(methods)).groupBy(*SERIES).agg(
        F.count_if("event").alias("events"), F.count_if("_any").alias("alerts"), F.expr("percentile(cover_days, 0.5)").alias("cover")
    )


def silent_stockouts(labeled: DataFrame, methods: Sequence[str]) -> DataFrame:
    return alert_activity(labeled, methods).filter("events > 0 and alerts = 0")


def event_series_count(labeled: DataFrame) -> DataFrame:
    return labeled.filter("event").agg(F.count_distinct(*SERIES).alias("n_series"))


def cover_by_label(labeled: DataFrame, cap: float = 120.0) -> DataFrame:
    rows = labeled.filter(F.col("label_7d").isNotNull()).select("label_7d", F.least("cover_days", F.lit(cap)).alias("cover"))
    return grouped_quantiles(rows, ["label_7d"], {"lowest": ("cover", 0.0), "q25": ("cover", 0.25), "median": ("cover", 0.5), "q75": ("cover", 0.75), "highest": ("cover", 1.0)})


def timeline_ranking(labeled: DataFrame, rows: int = TIMELINE_ROWS) -> DataFrame:
    """All series with events, then the most alerted without, up to ``rows`` in total."""
    activity = alert_activity(labeled, ("cover", "prob")).select(*SERIES, "events", "alerts")
    hits, misses = activity.filter("events > 0"), activity.filter("events = 0")
    room = F.lit(rows) - hits.agg(F.count(F.lit(1))).scalar()
    # at most ``rows`` candidates are left to number
    top = misses.orderBy(F.desc("alerts"), *SERIES).limit(rows)
    numbered = top.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("alerts"), *SERIES))).filter(F.col("_n") <= room)
    return hits.unionByName(numbered.drop("_n"))


def high_alerts(alerts: DataFrame, n: int = 15) -> DataFrame:
    return alerts.filter("severity = 'high'").orderBy(F.desc("p_stockout_7d"), *SERIES).limit(n)


# ------------------------------------------------------------------ series, stock and orders
def value_counts(series: DataFrame, alerts: DataFrame, orders: DataFrame) -> DataFrame:
    def one(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("column"), "value", "n")

    return one(series, "cluster").unionByName(one(alerts, "severity")).unionByName(one(orders, "flags")).unionByName(one(orders, "safety_stock_binding"))


def portfolio_days_on_hand(orders: DataFrame) -> DataFrame:
    return orders.agg(
        (F.sum("on_hand_projected") / F.nullif(F.sum("demand_p50"), F.lit(0.0)) * F.max("protection_period_days")).alias("days_on_hand"),
        F.count_if(F.col("safety_stock_binding") == "policy_days").alias("lines_bound_by_policy"),
        F.count_if(F.col("flags") != "").alias("flagged_lines"),
        F.count(F.lit(1)).alias("lines"),
    )


def representative_series(series: DataFrame) -> DataFrame:
    """The largest series of each of four segments."""
    segments = F.array_compact(F.array(
        *[F.when(F.col("cluster") == c, c) for c in ("A-X", "A-Z", "B-Z")], F.when(F.col("is_discontinued"), "discontinued")
    ))
    largest = F.max(F.struct("mean_weekly", (-F.col("upc")).alias("neg_upc"), "cedis"))
    return series.filter(F.col("mean_weekly").isNotNull()).withColumn("segment", F.explode(segments)).groupBy("segment").agg(largest.alias("b")).select(
        "segment", (-F.col("b.neg_upc")).alias("upc"), "b.cedis", "b.mean_weekly"
    )


def representative_history(series: DataFrame, weekly: DataFrame, last_week: date, weeks: int = 52) -> DataFrame:
    recent = weekly.filter(F.col("week_start") > F.lit(last_week - timedelta(weeks=weeks))).select(*SERIES, "week_start", "y", "promo_share")
    # at most four rows, one per segment
    return recent.join(F.broadcast(representative_series(series).select("segment", *SERIES)), list(SERIES))


def portfolio_outlook(weekly: DataFrame, forecast: DataFrame, weeks: int = 52) -> DataFrame:
    """Total sales of the last weeks followed by the summed forecast quantiles."""
    newest = weekly.agg(F.max("week_start")).scalar()
    past = weekly.withColumn("_newest", newest).filter(F.col("week_start") > F.date_sub("_newest", 7 * weeks)).groupBy("week_start").agg(F.sum("y").alias("y"))
    ahead = forecast.groupBy(F.col("target_week").alias("week_start")).agg(*[F.sum(q).alias(q) for q in QCOLS])
    return past.select("week_start", "y", *[F.lit(None).cast("double").alias(q) for q in QCOLS]).unionByName(
        ahead.select("week_start", F.lit(None).cast("double").alias("y"), *QCOLS)
    )


def cluster_weeks(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("cluster", "week_start").agg(F.sum("y").alias("y"), F.count_distinct(*SERIES).alias("n_series"))


def promo_lift(daily: DataFrame) -> DataFrame:
    """Mean of promoted over other days per series that has both."""
    mean_when = lambda flag: F.avg(F.when(F.col("promo_flag") == flag, F.col("sell_out_pzs")))
    both = daily.filter(F.col("sell_out_pzs").isNotNull()).groupBy(*SERIES).agg(mean_when(0).alias("base"), mean_when(1).alias("promo"))
    return both.filter(F.col("base").isNotNull() & F.col("promo").isNotNull()).withColumn("lift", F.col("promo") / F.nullif("base", F.lit(0.0)))


def promo_summary(daily: DataFrame) -> DataFrame:
    share = daily.filter(F.col("sell_out_pzs").isNotNull()).agg(F.avg("promo_flag")).scalar()
    return grouped_quantiles(promo_lift(daily), [], {"median_lift": ("lift", 0.5)}).withColumn("promo_share", share)


def _relative_days(daily: DataFrame) -> DataFrame:
    level = F.avg("sell_out_pzs").over(Window.partitionBy(*SERIES))
    return daily.filter(F.col("sell_out_pzs").isNotNull()).withColumn("rel", F.col("sell_out_pzs") / F.nullif(level, F.lit(0.0)))


def weekday_index(daily: DataFrame) -> DataFrame:
    return _relative_days(daily).groupBy(F.weekday("date").alias("dow")).agg(F.avg("rel").alias("index"))


def calendar_effects(daily: DataFrame) -> DataFrame:
    flags = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in EFFECT_FLAGS])
    return _relative_days(daily).select("rel", F.explode(flags).alias("f")).groupBy("f.flag", "f.value").agg(F.avg("rel").alias("index"), F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str], percentiles: dict[str, float]) -> DataFrame:
    """count, mean, std, min, percentiles and max, one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("v").isNotNull())
    table = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return join_groups(table, grouped_quantiles(rows, ["column"], {n: ("v", q) for n, q in percentiles.items()}), ["column"])


def short_series(inventory_cedis: DataFrame, share: float = 0.25) -> DataFrame:
    return inventory_cedis.filter(F.col("stockout_store_share") >= share).agg(F.count_distinct(*SERIES).alias("n_series"))


def discontinued_list(series: DataFrame) -> DataFrame:
    return series.filter("is_discontinued").select(*SERIES, "cluster", "mean_weekly", "tail4_mean")


def top_orders(orders: DataFrame, n: int = 10) -> DataFrame:
    return orders.orderBy(F.desc("working_capital"), *SERIES).limit(n).select(
        *SERIES, "cluster", "on_hand_projected", "demand_p50", "demand_p90", "safety_stock", "order_qty", "implied_service_level", "working_capital", "ma4_order_qty", "flags"
    )
