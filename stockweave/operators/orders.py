"""Replenishment: order-up-to quantities, outcome metrics, baseline policies and summaries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import dist
from stockweave.functions.metrics import weighted_mean
from stockweave.params import QCOLS, SERIES, Params

# The columns of the order file, in file order.
ORDER_COLUMNS = (
    "upc", "cedis", "cluster", "model", "origin", "protection_period_days", "on_hand_as_of", "sales_after_snapshot",
    "on_hand_projected", "demand_p50", "demand_p90", "demand_mean", "service_level_target", "safety_stock_policy",
    "safety_stock_quantile", "safety_stock", "safety_stock_binding", "order_up_to", "moq", "order_qty",
    "implied_service_level", "expected_fill_rate", "expected_lost_sales", "days_of_cover_after_order", "unit_value",
    "working_capital", "stock_value_after_order", "ma4_order_qty", "ma4_service_level", "ma4_expected_lost_sales",
    "ma4_working_capital", "ly_order_qty", "ly_service_level", "ly_working_capital", "delta_working_capital_vs_ma4",
    "delta_service_level_vs_ma4", "delta_lost_sales_vs_ma4", "fq_order_up_to", "fq_order_qty", "fq_service_level",
    "fq_expected_lost_sales", "fq_working_capital", "target_stock_value", "fq_target_stock_value", "flags",
)


def protection_days(lead_time: Column, review_days: int) -> Column:
    return lead_time + review_days


def protection_weeks(lead_time: Column, review_days: int) -> Column:
    """Weeks covering lead time plus review period, per row."""
    return F.ceil(protection_days(lead_time, review_days) / 7).cast("int")


def moq_round_up(qty: Column, moq: Column) -> Column:
    return F.when(qty <= 0, F.lit(0.0)).otherwise((F.ceil(qty / moq) * moq).cast("double"))


def _lead_times(series: DataFrame) -> DataFrame:
    return series.select(*SERIES, "lead_time_days")


def protection_demand(forecast: DataFrame, series: DataFrame, review_days: int = 7) -> DataFrame:
    """Sum of the first weekly quantiles inside each series' protection period."""
    inside = forecast.join(_lead_times(series), list(SERIES)).filter(F.col("h") <= protection_weeks(F.col("lead_time_days"), review_days))
    return inside.groupBy(*SERIES).agg(*[F.sum(q).alias(q) for q in QCOLS], F.count(F.lit(1)).alias("weeks_available"))


def naive_demands(weekly: DataFrame, series: DataFrame, origin: date, review_days: int = 7) -> DataFrame:
    """Moving-average and last-year demand over the protection period; last year falls back to the average."""
    newest = Window.partitionBy(*SERIES).orderBy(F.col("y").isNull(), F.desc("week_start"))
    past = weekly.filter(F.col("week_start") <= F.lit(origin)).join(_lead_times(series).select(*SERIES, F.col("lead_time_days").alias("_lead")), list(SERIES))
    weeks = protection_weeks(F.col("_lead"), review_days)
    first = F.lit(origin - timedelta(weeks=51))
    last_year = F.col("week_start").between(first, F.date_add(first, 7 * (weeks - 1)))
    per_series = past.withColumn("_rank", F.row_number().over(newest)).groupBy(*SERIES).agg(
        F.avg(F.when(F.col("_rank") <= 4, F.col("y"))).alias("ma4_weekly"),
        F.sum(F.when(last_year, F.col("y"))).alias("ly"),
        F.max(weeks).alias("weeks"),
    )
    return per_series.filter(F.col("ma4_weekly").isNotNull()).select(
        *SERIES, "ma4_weekly", (F.col("ma4_weekly") * F.col("weeks")).alias("ma4_demand"),
        F.coalesce("ly", F.col("ma4_weekly") * F.col("weeks")).alias("ly_demand"),
    )


def unit_prices(weekly: DataFrame, origin: date) -> DataFrame:
    recent = weekly.filter(F.col("week_start") > F.lit(origin - timedelta(weeks=4)))
    return recent.groupBy(*SERIES).agg(F.avg("price_mean").alias("unit_price"))


def sales_between(daily: DataFrame, after: date, before: date) -> DataFrame:
    inside = daily.filter((F.col("date") > F.lit(after)) & (F.col("date") < F.lit(before)))
    return inside.groupBy(*SERIES).agg(F.coalesce(F.sum("sell_out_pzs"), F.lit(0.0)).alias("sales_after_snapshot"))


def projected_stock(series: DataFrame, daily: DataFrame, as_of: date, period_start: date) -> DataFrame:
    """Stock at the start of the protection period: snapshot minus later sales, never negative."""
    return (
        series.select(*SERIES, "on_hand_as_of").join(sales_between(daily, as_of, period_start), list(SERIES), "left")
        .select(
            *SERIES,
            F.coalesce("on_hand_as_of", F.lit(0.0)).alias("on_hand_as_of"),
            F.coalesce("sales_after_snapshot", F.lit(0.0)).alias("sales_after_snapshot"),
            F.col("on_hand_as_of").isNull().alias("no_inventory_snapshot"),
        )
        .withColumn("on_hand_projected", F.greatest(F.col("on_hand_as_of") - F.col("sales_after_snapshot"), F.lit(0.0)))
    )


def order_inputs(forecast: DataFrame, series: DataFrame, weekly: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """One row per forecast series with demand, stock, price and catalog terms; all joins are on the series key."""
    key = list(SERIES)
    head = forecast.filter("h = 1").select(*SERIES, "model", "is_cold_start")
    facts = series.select(
        *SERIES, "cluster", "abc_class", "xyz_class", "lead_time_days", "moq", "safety_stock_days", "is_discontinued", "is_high_promo", "mean_weekly"
    )
    return (
        protection_demand(forecast, series, p.review_days)
        .join(facts, key, "left")
        .join(head, key, "left")
        .join(naive_demands(weekly, series, p.last_week, p.review_days), key, "left")
        .join(unit_prices(weekly, p.last_week), key, "left")
        .join(projected_stock(series, daily, p.as_of, p.last_week + timedelta(weeks=1)), key, "left")
        .withColumn("unit_value", F.col("unit_price") * p.cost_ratio)
    )


def with_distribution(d: DataFrame, p: Params) -> DataFrame:
    """Demand distribution over the protection period and the service-level target of the class."""
    mu, sigma = dist.lognormal_params(F.col("q50"), F.col("q90"))
    target = F.lit(min(p.service_levels.values()))
    for cls, level in p.service_levels.items():
        target = F.when(F.col("abc_class") == cls, F.lit(level)).otherwise(target)
    return d.withColumns({"_mu": mu, "_sigma": sigma, "service_level_target": target}).withColumns({
        "demand_p50": F.col("q50"),
        "demand_p90": F.col("q90"),
        "demand_mean": dist.mean(F.col("_mu"), F.col("_sigma")),
        "protection_period_days": protection_days(F.col("lead_time_days"), p.review_days).cast("int"),
        "daily_mean": F.col("q50") / protection_days(F.col("lead_time_days"), p.review_days),
    })


def with_safety_stock(d: DataFrame, p: Params) -> DataFrame:
    z = dist.normal_quantile_of(F.col("service_level_target"), set(p.service_levels.values()))
    return d.withColumns({
        "safety_stock_policy": F.col("safety_stock_days") * F.col("daily_mean"),
        "safety_stock_quantile": dist.quantile(F.col("_mu"), F.col("_sigma"), z) - F.col("demand_p50"),
    }).withColumns({
        "safety_stock": F.greatest("safety_stock_policy", "safety_stock_quantile"),
        "safety_stock_binding": F.when(F.col("safety_stock_policy") >= F.col("safety_stock_quantile"), "policy_days").otherwise("forecast_quantile"),
    })


def _place(d: DataFrame, prefix: str, target: Column) -> DataFrame:
    """Order and outcomes that lift the projected stock to ``target`` under the model's demand distribution."""
    need = F.greatest(target - F.col("on_hand_projected"), F.lit(0.0))
    qty = F.when(F.col("is_discontinued"), F.lit(0.0)).otherwise(moq_round_up(need, F.col("moq")))
    service = "implied_service_level" if not prefix else f"{prefix}service_level"
    placed = d.withColumn(f"{prefix}order_qty", qty).withColumn("_stock", F.col("on_hand_projected") + F.col(f"{prefix}order_qty"))
    placed = dist.with_outcomes(placed, "_stock", "_mu", "_sigma", exceeds="_p", shortfall=f"{prefix}expected_lost_sales")
    return placed.withColumns({
        service: 1.0 - F.col("_p"), f"{prefix}working_capital": F.col(f"{prefix}order_qty") * F.col("unit_value"),
    }).drop("_p", "_stock")


def with_orders(d: DataFrame) -> DataFrame:
    """Recommended order, the forecast-only variant and the two baseline policies."""
    d = d.withColumn("order_up_to", F.col("demand_p50") + F.col("safety_stock"))
    d = _place(d, "", F.col("order_up_to"))
    stock = F.col("on_hand_projected") + F.col("order_qty")
    floor = F.lit(1e-6)
    d = d.withColumns({
        "expected_fill_rate": 1.0 - F.col("expected_lost_sales") / F.greatest("demand_mean", floor),
        "stock_value_after_order": stock * F.col("unit_value"),
        "days_of_cover_after_order": stock / F.greatest("daily_mean", floor),
        "fq_order_up_to": F.col("demand_p50") + F.greatest("safety_stock_quantile", F.lit(0.0)),
    })
    d = _place(d, "fq_", F.col("fq_order_up_to"))
    d = d.withColumns({
        "target_stock_value": F.col("order_up_to") * F.col("unit_value"),
        "fq_target_stock_value": F.col("fq_order_up_to") * F.col("unit_value"),
    })
    for name in ("ma4", "ly"):
        demand = F.col(f"{name}_demand")
        d = _place(d, f"{name}_", demand + F.col("safety_stock_days") * demand / F.col("protection_period_days"))
    return d.withColumns({
        "delta_working_capital_vs_ma4": F.col("working_capital") - F.col("ma4_working_capital"),
        "delta_service_level_vs_ma4": F.col("implied_service_level") - F.col("ma4_service_level"),
        "delta_lost_sales_vs_ma4": F.col("expected_lost_sales") - F.col("ma4_expected_lost_sales"),
    })


def review_flags(review_days: int) -> Column:
    return F.concat_ws(
        ";",
        F.when(F.col("is_cold_start"), "cold_start"),
        F.when(F.col("is_discontinued"), "discontinued_review"),
        F.when(F.col("is_high_promo"), "high_promo"),
        F.when(F.col("no_inventory_snapshot"), "no_inventory_snapshot"),
        F.when(F.col("weeks_available") < protection_weeks(F.col("lead_time_days"), review_days), "short_horizon"),
    )


def build_orders(forecast: DataFrame, series: DataFrame, weekly: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    d = with_orders(with_safety_stock(with_distribution(order_inputs(forecast, series, weekly, daily, p), p), p))
    return d.withColumn("flags", review_flags(p.review_days)).withColumn("origin", F.lit(p.last_week)).drop("_mu", "_sigma")


def order_file(orders: DataFrame) -> DataFrame:
    return orders.select(*ORDER_COLUMNS).orderBy("cluster", *SERIES)


# Columns added up in the summaries, output name -> order column.
TOTALS = {
    "order_units": "order_qty", "working_capital": "working_capital", "expected_lost_units": "expected_lost_sales",
    "demand_mean_units": "demand_mean", "ma4_order_units": "ma4_order_qty", "ma4_working_capital": "ma4_working_capital",
    "ma4_expected_lost_units": "ma4_expected_lost_sales", "ly_order_units": "ly_order_qty", "ly_working_capital": "ly_working_capital",
    "fq_order_units": "fq_order_qty", "fq_working_capital": "fq_working_capital", "fq_expected_lost_units": "fq_expected_lost_sales",
    "target_stock_value": "target_stock_value", "fq_target_stock_value": "fq_target_stock_value",
}
SERVICE = {"": "implied_service_level", "ma4_": "ma4_service_level", "fq_": "fq_service_level"}


def summarize(orders: DataFrame) -> DataFrame:
    """Portfolio, per-cluster and per-centre totals in one pass; ``level`` names the grouping."""
    cluster, cedis = F.col("cluster"), F.col("cedis")
    totals = orders.groupingSets([[], [cluster], [cedis]], cluster, cedis).agg(
        F.when(F.grouping_id() == 3, "portfolio").when(F.grouping_id() == 1, "cluster").otherwise("cedis").alias("level"),
        F.count(F.lit(1)).alias("n_series"),
        *[F.sum(c).alias(name) for name, c in TOTALS.items()],
        *[F.count_if(F.col(c) < 0.9).alias(f"{prefix}lines_below_90") for prefix, c in SERVICE.items()],
        *[weighted_mean(c, "demand_mean").alias(f"{prefix}service_level_weighted") for prefix, c in SERVICE.items()],
    )
    return totals.select(
        "level", F.when(F.col("level") == "cluster", cluster).when(F.col("level") == "cedis", cedis).otherwise("portfolio").alias("name"),
        *[c for c in totals.columns if c not in ("level", "cluster", "cedis")],
        *[(1 - F.col(f"{prefix}expected_lost_units") / F.col("demand_mean_units")).alias(f"{prefix}fill_rate") for prefix in SERVICE],
        (F.col("working_capital") - F.col("ma4_working_capital")).alias("delta_working_capital_vs_ma4"),
        (F.col("ma4_expected_lost_units") - F.col("expected_lost_units")).alias("lost_units_reduction_vs_ma4"),
        (F.col("target_stock_value") - F.col("fq_target_stock_value")).alias("target_stock_value_freed_by_fq"),
    )
