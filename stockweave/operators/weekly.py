"""Weekly modelling table and per-series facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.calendar import week_start
from stockweave.params import SERIES

CATALOG_COLS = ("cluster", "abc_class", "xyz_class", "lead_time_days", "moq", "safety_stock_days")


def complete_weeks(daily: DataFrame, first_week: date, last_week: date) -> DataFrame:
    return daily.withColumn("week_start", week_start(F.col("date"))).filter(F.col("week_start").between(F.lit(first_week), F.lit(last_week)))


def aggregate_weeks(daily: DataFrame, min_days: int = 5) -> DataFrame:
    """Weekly sums; price and promotion over observed days only; scaled to seven days or NULL."""
    y = F.col("sell_out_pzs")
    sums = daily.groupBy(*SERIES, "week_start").agg(
        F.sum(y).alias("y_sum"),
        F.sum("sell_out_capped").alias("capped_sum"),
        F.count(y).alias("days_observed"),
        F.avg(F.when(y.isNotNull(), F.col("final_price"))).alias("price_mean"),
        F.avg(F.when(y.isNotNull(), F.col("promo_flag"))).alias("promo_share"),
        F.sum("outlier_flag").alias("n_outliers"),
        F.count_if(y == 0).alias("zero_days"),
    )
    enough = F.col("days_observed") >= min_days
    factor = F.lit(7.0) / F.col("days_observed")
    return sums.select(
        *SERIES, "week_start", "days_observed", "price_mean", "promo_share", "n_outliers", "zero_days",
        F.when(enough, F.col("y_sum") * factor).alias("y"),
        F.when(enough, F.col("capped_sum") * factor).alias("y_capped"),
    )


def fill_week_grid(weeks: DataFrame, last_week: date) -> DataFrame:
    """Every week from the first with a usable ``y`` to ``last_week``, stretched from the row before a gap."""
    by_week = Window.partitionBy(*SERIES).orderBy("week_start")
    started = weeks.withColumn(
        "first_week", F.min(F.when(F.col("y").isNotNull(), F.col("week_start"))).over(Window.partitionBy(*SERIES))
    ).filter(F.col("week_start") >= F.col("first_week"))
    until = F.coalesce(F.date_sub(F.lead("week_start").over(by_week), 7), F.lit(last_week))
    price = F.last("price_mean", ignorenulls=True).over(by_week.rowsBetween(Window.unboundedPreceding, 0))
    grid = (
        started.withColumn("price_mean", price).withColumn("until", until).withColumn("seen_in", F.col("week_start"))
        .withColumn("week_start", F.explode(F.sequence("seen_in", "until", F.expr("interval 7 days"))))
    )
    seen = F.col("week_start") == F.col("seen_in")

    def if_seen(name: str, default: Column | None = None) -> Column:
        value = F.when(seen, F.col(name))
        return (F.coalesce(value, default) if default is not None else value).alias(name)

    return grid.select(
        *SERIES, "week_start",
        if_seen("days_observed", F.lit(0).cast("long")),
        "price_mean",
        if_seen("promo_share", F.lit(0.0)),
        if_seen("n_outliers", F.lit(0).cast("long")),
        if_seen("zero_days", F.lit(0).cast("long")),
        if_seen("y"),
        if_seen("y_capped"),
    ).withColumn("series_age_weeks", (F.row_number().over(by_week) - 1).cast("int"))


def attach_dimensions(weeks: DataFrame, weekly_cal: DataFrame, catalog: DataFrame) -> DataFrame:
    """Weekly calendar (one row per week, broadcast) and catalog columns (size decided by the planner)."""
    return weeks.join(F.broadcast(weekly_cal), "week_start", "left").join(catalog.select("upc", *CATALOG_COLS), "upc", "left")


def build_weekly(
    daily: DataFrame, weekly_cal: DataFrame, catalog: DataFrame, first_week: date, last_week: date, min_days: int = 5
) -> DataFrame:
    weeks = aggregate_weeks(complete_weeks(daily, first_week, last_week), min_days)
    return attach_dimensions(fill_week_grid(weeks, last_week), weekly_cal, catalog)


def observed_day_facts(daily: DataFrame) -> DataFrame:
    facts = daily.filter(F.col("sell_out_pzs").isNotNull()).groupBy(*SERIES).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_days"), F.avg("sell_out_pzs").alias("mean_daily"),
    )
    return facts.withColumn("interior_gap_days", (F.datediff("last_date", "first_date") + 1 - F.col("n_days")).cast("int"))


def observed_week_facts(weekly: DataFrame) -> DataFrame:
    """History length and level; the tails are counted from the last observed week of all series."""
    seen = weekly.filter(F.col("y").isNotNull())
    newest = seen.agg(F.max("week_start")).scalar()
    tail8 = F.col("week_start") > F.date_sub(F.col("newest"), 56)
    tail4 = F.col("week_start") > F.date_sub(F.col("newest"), 28)
    return seen.withColumn("newest", newest).groupBy(*SERIES).agg(
        F.min("week_start").alias("first_week"),
        F.count(F.lit(1)).alias("n_weeks"),
        F.avg("y").alias("mean_weekly"),
        F.avg(F.when(tail8, F.col("y"))).alias("tail8_mean"),
        F.avg(F.when(tail8, F.col("promo_share"))).alias("tail8_promo_share"),
        F.avg(F.when(tail4, F.col("y"))).alias("tail4_mean"),
    )


def stock_as_of(inventory_cedis: DataFrame, as_of: date) -> DataFrame:
    return inventory_cedis.filter(F.col("date") == F.lit(as_of)).select(*SERIES, F.col("on_hand").alias("on_hand_as_of"))


def build_series(
    daily: DataFrame, weekly: DataFrame, inventory_cedis: DataFrame, catalog: DataFrame, as_of: date, cold_start_weeks: int = 26
) -> DataFrame:
    """One row per series: history facts, stock at the as-of date and the flags that gate trust."""
    key = list(SERIES)
    mean = F.coalesce("mean_weekly", F.lit(0.0))
    return (
        observed_day_facts(daily)
        .join(observed_week_facts(weekly), key, "left")
        .join(stock_as_of(inventory_cedis, as_of), key, "left")
        .join(catalog.select("upc", *CATALOG_COLS), "upc", "left")
        .select(
            "*",
            F.col("on_hand_as_of").isNotNull().alias("has_inventory"),
            (F.coalesce("n_weeks", F.lit(0)) < cold_start_weeks).alias("is_cold_start"),
            ((F.coalesce("tail4_mean", F.lit(0.0)) <= 0.05 * mean) & (mean > 0)).alias("is_discontinued"),
            (F.coalesce("tail8_promo_share", F.lit(0.0)) >= 0.4).alias("is_high_promo"),
        )
    )


