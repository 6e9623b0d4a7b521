"""Daily grain: gap-aware grid and robust outlier flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.calendar import FLAGS
from stockweave.params import SERIES
from stockweave.sources.staging import spread


def _series_by_date(*extra: str) -> Window:
    return Window.partitionBy(*SERIES).orderBy("date", *extra)


def complete_daily_calendar(sell_out: DataFrame, end: Column) -> DataFrame:
    """One row per series and day from its first sale to ``end``; gaps stay NULL and are flagged.

    Each sale row is stretched over the days up to the next one, so the grid needs neither a
    calendar join nor a second shuffle: one exchange on the series key serves everything here.
    """
    by_date = _series_by_date()
    stretched = spread(sell_out.filter(F.col("date") <= end), *SERIES).select(
        *SERIES, "date", "sell_out_pzs", "promo_flag",
        F.last("final_price", ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, 0)).alias("final_price"),
        F.coalesce(F.date_sub(F.lead("date").over(by_date), 1), end).alias("until"),
    )
    days = stretched.withColumn("sold_on", F.col("date")).withColumn("date", F.explode(F.sequence("sold_on", "until")))
    observed = F.col("date") == F.col("sold_on")
    y = F.when(observed, F.col("sell_out_pzs"))
    return days.select(
        *SERIES, "date",
        y.alias("sell_out_pzs"),
        "final_price",
        F.coalesce(F.when(observed, F.col("promo_flag")), F.lit(0)).alias("promo_flag"),
        y.isNull().cast("int").alias("is_missing"),
    )


def _median(ordered: Column, min_obs: int) -> Column:
    """Median of a sorted array column, NULL below ``min_obs`` values."""
    n = F.size(ordered)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    return F.when(n >= min_obs, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def flag_outliers(daily: DataFrame, z: float, window: int = 56, min_obs: int = 14) -> DataFrame:
    """Robust z against the trailing median and MAD of the previous ``window`` rows.

    The deviations behind the MAD are each taken from the median of their own window. The
    original value is kept; ``sell_out_capped`` is the copy for training, capped on the high side.
    """
    y = F.col("sell_out_pzs")
    by_date = _series_by_date()
    past, recent = by_date.rowsBetween(-window, -1), by_date.rowsBetween(-(window - 1), 0)
    cap = F.col("med") + F.lit(z) * F.col("scale")
    score = F.abs((y - F.col("med")) / F.nullif(F.col("scale"), F.lit(0.0)))
    return (
        daily.withColumn("_w", F.sort_array(F.collect_list(y).over(past)))
        .withColumn("med", _median(F.col("_w"), min_obs))
        .withColumn("dev", F.abs(F.lag(y).over(by_date) - F.col("med")))
        .withColumn("_w", F.sort_array(F.collect_list("dev").over(recent)))
        .withColumn("scale", F.lit(1.4826) * _median(F.col("_w"), min_obs))
        .withColumn("outlier_flag", F.coalesce(score > z, F.lit(False)).cast("int"))
        .withColumn("sell_out_capped", F.when(F.col("outlier_flag") == 1, F.least(y, cap)).otherwise(y))
        .drop("_w", "med", "dev", "scale")
    )


def attach_calendar(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Flags and week of each day. The calendar has one row per day, so it is small by construction."""
    return daily.join(F.broadcast(calendar.select("date", *FLAGS, "week_start")), "date", "left")


def data_summary(daily: DataFrame) -> DataFrame:
    per_series = daily.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_missing").alias("n_missing"), F.sum("outlier_flag").alias("n_outliers"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return per_series.agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        (F.sum("n_missing") / F.sum("n_rows")).alias("missing_share"),
        F.sum("n_outliers").alias("n_outliers"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
