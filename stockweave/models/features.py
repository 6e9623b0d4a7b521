"""Lag, level and calendar features for the global model, and its supervised rows.

Everything at week t looks back from t on the dense weekly grid, so targets and last-year values
are leads and lags of the same window: one exchange on the series key, no self-joins, and the
table serves every fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.params import SERIES

# Lags, rolling windows and target-week calendar columns of the feature list.
LAGS = (1, 2, 3, 4, 5, 6, 7, 8)
ROLLS = (4, 8, 13, 26)
CALENDAR_COLS = ("payday_days", "holiday_days", "semana_santa_days", "buen_fin_days", "december_peak_days", "week_of_year", "month")
SEASON_WEEKS = 52

LEVEL_COLS = (
    "scale", "log_scale", *[f"lag{k}" for k in LAGS], *[f"roll{w}" for w in ROLLS], "roll8_std", "trend4_13",
    "price_last", "price_ratio4", "promo_last", "promo_roll4", "zero_days_last", "series_age",
)


def _by_week() -> Window:
    return Window.partitionBy(*SERIES).orderBy("week_start")


def _rolling(column: str, weeks: int, min_obs: int, how=F.avg) -> Column:
    frame = _by_week().rowsBetween(-(weeks - 1), 0)
    return F.when(F.count(column).over(frame) >= min_obs, how(column).over(frame))


def series_features(weekly: DataFrame) -> DataFrame:
    """Features observable at each week, levels divided by the recent mean."""
    y = F.col("y_capped")
    by_week = _by_week()
    d = weekly.withColumn("scale", _rolling("y_capped", 13, 4)).withColumn("scale", F.when(F.col("scale").isNotNull(), F.greatest("scale", F.lit(1.0))))
    scale = F.col("scale")
    cols: dict[str, Column] = {"log_scale": F.log1p(scale)}
    cols |= {f"lag{k}": (y if k == 1 else F.lag(y, k - 1).over(by_week)) / scale for k in LAGS}
    cols |= {f"roll{w}": _rolling("y_capped", w, 2) / scale for w in ROLLS}
    cols["roll8_std"] = _rolling("y_capped", 8, 3, F.stddev_samp) / scale
    cols["price_ratio4"] = F.col("price_mean") / _rolling("price_mean", 4, 1)
    cols["promo_roll4"] = _rolling("promo_share", 4, 1)
    return d.withColumns(cols).select(
        "*", (F.col("roll4") - F.col("roll13")).alias("trend4_13"), F.col("price_mean").alias("price_last"),
        F.col("promo_share").alias("promo_last"), F.col("zero_days").alias("zero_days_last"), F.col("series_age_weeks").alias("series_age"),
    )


#: Rows at which a product's or centre's own mean counts as much as its cluster's.
STAT_WEIGHT = 20.0


def target_statistics(features: DataFrame) -> DataFrame:
    """Adds ``upc_stat`` and ``cedis_stat``: smoothed means of the one-step target over the weeks before each row's week.

    The target of a week is its capped sales over the scale known a week earlier. A mean is drawn to that of the cluster, and the
    cluster's to 1. Sums are taken per key and week first, so a window has a row for each week and no target of the row's own
    week or later enters.
    """
    label = F.col("y_capped") / F.lag("scale").over(_by_week())
    rows = features.withColumns({"_label": label, "_cluster": F.coalesce("cluster", F.lit(""))})

    def before(key: str, name: str) -> DataFrame:
        weekly = rows.groupBy(key, "week_start").agg(F.sum("_label").alias("s"), F.count("_label").alias("n"))
        past = Window.partitionBy(key).orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)
        return weekly.select(key, "week_start", *[F.coalesce(F.sum(c).over(past), F.lit(0)).cast("double").alias(f"{name}_{c}") for c in ("s", "n")])

    for key, name in (("_cluster", "k"), ("upc", "u"), ("cedis", "c")):
        rows = rows.join(before(key, name), [key, "week_start"])
    weight = F.lit(STAT_WEIGHT)
    prior = (F.col("k_s") + weight) / (F.col("k_n") + weight)
    stats = {f"{key}_stat": (F.col(f"{n}_s") + weight * prior) / (F.col(f"{n}_n") + weight) for key, n in (("upc", "u"), ("cedis", "c"))}
    return rows.withColumns(stats).select(*features.columns, *stats)


def lag52_lookup(weekly: DataFrame) -> DataFrame:
    """Capped sales keyed by the week they are last year's value of."""
    return weekly.select(*SERIES, F.date_add("week_start", 7 * SEASON_WEEKS).alias("target_week"), F.col("y_capped").alias("lag52_target_raw"))


def calendar_union(train: DataFrame, future: DataFrame) -> DataFrame:
    """Calendar of history and future weeks, one row per week."""
    past = train.select("week_start", *CALENDAR_COLS)
    return past.unionByName(future.select(F.col("target_week").alias("week_start"), *CALENDAR_COLS)).dropDuplicates(["week_start"])


def horizon_rows(weekly: DataFrame, weekly_cal: DataFrame, horizon: int) -> DataFrame:
    """One row per week and step ahead: features at the week, calendar and scaled value of the target week.

    The target is NULL where it is not observed yet; those rows serve inference.
    """
    by_week = _by_week()
    y = F.col("y_capped")
    steps = F.array(*[
        F.struct(
            F.lit(h).alias("h"), F.lead(y, h).over(by_week).alias("y_target"), F.lag(y, SEASON_WEEKS - h).over(by_week).alias("lag52_target_raw")
        )
        for h in range(1, horizon + 1)
    ])
    base = target_statistics(series_features(weekly).withColumn("_steps", steps))
    rows = base.select(*SERIES, "week_start", "cluster", "abc_class", "xyz_class", *LEVEL_COLS, "upc_stat", "cedis_stat", F.explode("_steps").alias("s"))
    rows = rows.select(
        *[c for c in rows.columns if c != "s"], "s.*", F.date_add("week_start", F.col("s.h") * 7).alias("target_week"),
        (F.col("s.y_target") / F.col("scale")).alias("y_scaled"), (F.col("s.lag52_target_raw") / F.col("scale")).alias("lag52_target"),
    )
    calendar = weekly_cal.select(F.col("week_start").alias("target_week"), *CALENDAR_COLS)
    return rows.join(F.broadcast(calendar), "target_week", "left")


def supervised(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("y_scaled").isNotNull() & F.col("lag1").isNotNull())


def inference(rows: DataFrame, origin) -> DataFrame:
    """Latest feature row of every series at the origin, one per step."""
    return rows.filter(F.col("week_start") == F.lit(origin))
