"""

Queries share the stage tables of one run per session and input folder; a stage is rebuilt
when the input files change.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
from stockweave.functions import calendar as cal  # noqa: E402
from stockweave.functions import dist  # noqa: E402
from stockweave.functions import metrics as M  # noqa: E402
from stockweave.functions.quantiles import finalize  # noqa: E402
from stockweave.models import ets, features, future, naive  # noqa: E402
from stockweave.operators import daily as D  # noqa: E402
from stockweave.operators import gates as G  # noqa: E402
from stockweave.operators import inventory as I  # noqa: E402
from stockweave.operators import orders as O  # noqa: E402
from stockweave.operators import reporting as RP  # noqa: E402
from stockweave.operators import risk as R  # noqa: E402
from stockweave.operators import validate as V  # noqa: E402
from stockweave.operators import weekly as W  # noqa: E402
from stockweave.params import QCOLS, SERIES, Params  # noqa: E402
from stockweave.plans import backtest as B  # noqa: E402
from stockweave.plans.pipeline import ALL_MODELS, NAIVE_MODELS, Pipeline  # noqa: E402
from stockweave.sources import adapter, files, schemas  # noqa: E402
from stockweave.sources.staging import StageStore, fingerprint  # noqa: E402

SOURCES = ("lineitem", "part")
_stores: dict[tuple, StageStore] = {}


def run_for(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = NAIVE_MODELS, grain: str = "type_flag") -> Pipeline:
    """The run whose stage tables belong to this session, folder and state of the input files."""
    key = (spark.sparkContext.applicationId, sf_dir, grain, fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in SOURCES]))
    if key not in _stores:
        _stores[key] = StageStore(spark, grain)
    return Pipeline(spark, sf_dir, grain=grain, models=models, store=_stores[key])


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four decimals; the cut sits off exact halves so that last-bit differences in sums cannot flip it.

    NaN, infinity and values too large for decimals to matter stay as they are.
    """
    return df.select(*[
        F.when(F.abs(f.name) < 1e11, F.floor(F.col(f.name) * 1e4 + 0.5003) / 1e4).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema
    ])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FUNCTIONS: dict[str, Callable[[Pipeline], DataFrame]] = {}


def register(name: str, models: tuple[str, ...] = NAIVE_MODELS):
    def add(fn: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
        FUNCTIONS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(run_for(spark, sf_dir, models)))
        return fn

    return add


# ------------------------------------------------------------------ sources and checks
@register("a1_scan_sell_out")
def _(r: Pipeline) -> DataFrame:
    return files.check_sell_out(r.sell_out())


@register("a2_store_catalog")
def _(r: Pipeline) -> DataFrame:
    return files.check_stores(r.stores())


@register("a3_product_catalog")
def _(r: Pipeline) -> DataFrame:
    return I.dedupe_catalog(files.check_catalog(r.catalog_raw()))


@register("a4_scan_inventory")
def _(r: Pipeline) -> DataFrame:
    return I.load_inventory(files.check_inventory(r.inventory()), r.stores())


@register("a5_schema_violations")
def _(r: Pipeline) -> DataFrame:
    """Inventory against its schema with a key that ignores the item number, so duplicates show."""
    return V.violations(r.inventory(), schemas.INVENTORY, "inventory", key=["date", "upc", "store_nbr"], non_null=["date", "upc", "on_hand_qty"])


@register("a6_negative_values")
def _(r: Pipeline) -> DataFrame:
    sales = V.count_negative(r.sell_out(), "sell_out_pzs").withColumn("relation", F.lit("sell_out"))
    return sales.unionByName(V.count_negative(r.inventory(), "on_hand_qty").withColumn("relation", F.lit("inventory")))


@register("a7_unmatched_keys")
def _(r: Pipeline) -> DataFrame:
    """Sold products outside the class-A catalog, and stores the store catalog lacks."""
    class_a = r.catalog().filter("abc_class = 'A'")
    upcs = V.unmatched_keys(r.sell_out(), class_a, "upc").select(F.lit("upc").alias("key"), F.col("upc").alias("value"))
    return upcs.unionByName(V.unmatched_keys(r.inventory(), r.stores(), "store_nbr").select(F.lit("store_nbr").alias("key"), F.col("store_nbr").alias("value")))


@register("a8_join_cardinality")
def _(r: Pipeline) -> DataFrame:
    checks = {"stores": (r.stores(), ["store_nbr"]), "catalog_raw": (r.catalog_raw(), ["upc"]), "catalog": (r.catalog(), ["upc"]), "sell_out": (r.sell_out(), ["upc", "cedis", "date"])}
    parts = [V.duplicate_rows(df, key).withColumn("relation", F.lit(name)) for name, (df, key) in checks.items()]
    return B.union_models(parts)


@register("a9_parquet_round_trip")
def _(r: Pipeline) -> DataFrame:
    path = f"{r.store.root}/exports/predictions"
    files.write_parquet(r.backtest(), path, ["fold"])
    back = files.read_parquet(r.spark, path, r.backtest().schema)
    return back.select("model", "upc", "cedis", "fold", "h", "target_week", "q05", "q10", "q50", "q90", "q95", "y")


@register("a10_csv_round_trip")
def _(r: Pipeline) -> DataFrame:
    path = f"{r.store.root}/exports/sell_out_csv"
    files.write_csv(r.sell_out(), path)
    return files.check_sell_out(files.read_csv(r.spark, path))


@register("a11_inventory_coverage")
def _(r: Pipeline) -> DataFrame:
    return I.coverage_by_date(r.stock())


@register("a12_series_coverage")
def _(r: Pipeline) -> DataFrame:
    return r.series().select(*SERIES, "cluster", "first_date", "n_days", "n_weeks", "is_cold_start", "is_discontinued", "has_inventory")


# ------------------------------------------------------------------ daily grain
@register("b1_collapse_item_numbers")
def _(r: Pipeline) -> DataFrame:
    return I.collapse_items(r.inventory())


@register("b2_inventory_by_centre")
def _(r: Pipeline) -> DataFrame:
    return I.aggregate_to_cedis(r.stock())


@register("b2_inventory_by_centre_unclipped")
def _(r: Pipeline) -> DataFrame:
    return I.aggregate_to_cedis(r.stock(), clip_negative=False)


@register("b3_daily_grid")
def _(r: Pipeline) -> DataFrame:
    return D.complete_daily_calendar(r.sell_out(), r.last_sale())


@register("b4_outliers")
def _(r: Pipeline) -> DataFrame:
    grid = D.complete_daily_calendar(r.sell_out(), r.last_sale())
    return D.flag_outliers(grid, r.p.outlier_z).select(*SERIES, "date", "sell_out_pzs", "outlier_flag", "sell_out_capped")


@register("b5_daily_with_calendar")
def _(r: Pipeline) -> DataFrame:
    return D.attach_calendar(r.daily().drop(*cal.FLAGS, "week_start"), r.calendar())


@register("b6_data_summary")
def _(r: Pipeline) -> DataFrame:
    return D.data_summary(r.daily())


# ------------------------------------------------------------------ calendar
@register("c123_moving_feasts")
def _(r: Pipeline) -> DataFrame:
    """Third Monday of November, Buen Fin and Semana Santa of every year with sales."""
    years = r.sell_out().select(F.year("date").alias("year")).distinct()
    monday, easter = cal.nth_monday(F.col("year"), 11, 3), cal.easter_sunday(F.col("year"))
    return years.select(
        "year", monday.alias("third_monday"), F.date_sub(monday, 3).alias("buen_fin_first"), F.date_sub(easter, 7).alias("palm_sunday"), easter.alias("easter_sunday")
    )


@register("c4_daily_calendar")
def _(r: Pipeline) -> DataFrame:
    return cal.daily_calendar(r.spark, r.p.first_week, F.date_add(r.last_sale(), r.p.calendar_tail_days))


@register("c5_weekly_calendar")
def _(r: Pipeline) -> DataFrame:
    return cal.weekly_calendar(r.calendar())


# ------------------------------------------------------------------ weekly table and series
@register("d1_complete_weeks")
def _(r: Pipeline) -> DataFrame:
    return W.complete_weeks(r.daily(), r.p.first_week, r.p.last_week).groupBy("week_start").agg(
        F.count(F.lit(1)).alias("days"), F.sum("sell_out_pzs").alias("units")
    )


@register("d2_week_sums")
def _(r: Pipeline) -> DataFrame:
    return W.aggregate_weeks(W.complete_weeks(r.daily(), r.p.first_week, r.p.last_week))


@register("d4_week_grid")
def _(r: Pipeline) -> DataFrame:
    return W.fill_week_grid(W.aggregate_weeks(W.complete_weeks(r.daily(), r.p.first_week, r.p.last_week)), r.p.last_week)


@register("d_weekly_table")
def _(r: Pipeline) -> DataFrame:
    return W.build_weekly(r.daily(), r.weekly_calendar(), r.catalog(), r.p.first_week, r.p.last_week)


@register("e1_observed_day_facts")
def _(r: Pipeline) -> DataFrame:
    return W.observed_day_facts(r.daily())


@register("e3_observed_week_facts")
def _(r: Pipeline) -> DataFrame:
    return W.observed_week_facts(r.weekly())


@register("e5_stock_as_of")
def _(r: Pipeline) -> DataFrame:
    return W.stock_as_of(r.inventory_cedis(), r.p.as_of)


@register("e_series_table")
def _(r: Pipeline) -> DataFrame:
    return W.build_series(r.daily(), r.weekly(), r.inventory_cedis(), r.catalog(), r.p.as_of, r.p.cold_start_weeks)


# ------------------------------------------------------------------ forecasters
@register("f1_future_grid")
def _(r: Pipeline) -> DataFrame:
    train = future.with_folds(r.weekly().select(*SERIES, "week_start"), r.p.fold_origins())
    return future.make_future(train, r.p.horizon, r.weekly_calendar())


@register("f2_finalize_quantiles")
def _(r: Pipeline) -> DataFrame:
    """Row repair on unordered, partly negative values built from the weekly table."""
    y, age = F.col("y"), F.col("series_age_weeks") % 5
    raw = r.weekly().filter(y.isNotNull()).select(
        *SERIES, "week_start", (y - 40 * age).alias("q05"), (y + 10).alias("q10"), (y * 0.5).alias("q50"), (y - 3 * age).alias("q90"), (y * 0.9).alias("q95")
    )
    return finalize(raw)


@register("f3_moving_average")
def _(r: Pipeline) -> DataFrame:
    return naive.moving_average(r.weekly(), r.p.fold_origins(), r.p.horizon)


@register("f3r_moving_average_residuals")
def _(r: Pipeline) -> DataFrame:
    return naive.residual_columns(r.weekly(), 4, r.p.horizon)


@register("f4_seasonal_naive")
def _(r: Pipeline) -> DataFrame:
    return naive.seasonal_naive(r.weekly(), r.p.fold_origins(), r.p.horizon)


@register("f6_damped_trend_fit")
def _(r: Pipeline) -> DataFrame:
    return ets.fit(r.weekly(), r.p.fold_origins())


@register("f6_damped_trend")
def _(r: Pipeline) -> DataFrame:
    return ets.ets_damped(r.weekly(), r.p.fold_origins(), r.p.horizon)


@register("f6i_interpolated_history")
def _(r: Pipeline) -> DataFrame:
    filled = future.with_folds(ets.interpolate_gaps(r.weekly().select(*SERIES, "week_start", "y_capped"), "y_capped"), r.p.fold_origins())
    return filled.select(*future.FOLD_KEY, "week_start", ets.interpolated_value(F.col("origin")).alias("yi"))


@register("f7_series_features")
def _(r: Pipeline) -> DataFrame:
    return features.series_features(r.weekly()).select(*SERIES, "week_start", *features.LEVEL_COLS)


@register("f8_last_year_lookup")
def _(r: Pipeline) -> DataFrame:
    return features.lag52_lookup(r.weekly())


@register("f9_supervised_rows")
def _(r: Pipeline) -> DataFrame:
    rows = features.supervised(r.horizon_rows())
    return rows.select(*SERIES, "week_start", "h", "target_week", "lag1", "roll13", "lag52_target", "y_scaled", *features.CALENDAR_COLS)


@register("f10_inference_rows")
def _(r: Pipeline) -> DataFrame:
    rows = features.inference(r.horizon_rows(), r.p.last_week)
    return rows.select(*SERIES, "h", "target_week", "scale", "lag1", "roll4", "lag52_target", *features.CALENDAR_COLS)


@register("f11_encoded_features")
def _(r: Pipeline) -> DataFrame:
    from stockweave.models import gbt

    rows = features.inference(r.horizon_rows(), r.p.last_week)
    return gbt.encode(rows).select(*SERIES, *gbt.FEATURES)


@register("f12_boosted_quantiles", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.backtest().filter("model = 'gbt'")


@register("f13_calendar_union")
def _(r: Pipeline) -> DataFrame:
    train = r.weekly().filter(F.col("week_start") <= F.lit(r.p.risk_origin))
    grid = future.make_future(future.with_folds(r.weekly().select(*SERIES, "week_start"), [r.p.risk_origin]), r.p.horizon, r.weekly_calendar())
    return features.calendar_union(train, grid)


# ------------------------------------------------------------------ backtest
@register("g1_fold_origins")
def _(r: Pipeline) -> DataFrame:
    """Origins with the number of series that have history there."""
    seen = future.with_folds(r.weekly().select(*SERIES, "week_start"), r.p.fold_origins())
    return seen.groupBy("fold", "origin").agg(F.count_distinct(*SERIES).alias("n_series"))


@register("g2_eligible_series")
def _(r: Pipeline) -> DataFrame:
    return future.eligible_series(future.with_folds(r.weekly(), r.p.fold_origins()), r.p.cold_start_weeks)


@register("g3_backtest_predictions")
def _(r: Pipeline) -> DataFrame:
    return r.backtest()


@register("g3_backtest_predictions_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.backtest()


@register("g4_rows_by_model_and_fold")
def _(r: Pipeline) -> DataFrame:
    return r.backtest().groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("n_with_actual"))


@register("g5_interval_calibration")
def _(r: Pipeline) -> DataFrame:
    return r.calibration()


@register("g6_apply_calibration")
def _(r: Pipeline) -> DataFrame:
    late = r.backtest().filter(F.col("fold") >= r.p.n_calibration_folds)
    return B.apply_calibration(late, r.calibration())


for _level in B.LEVELS_REPORTED:
    register(f"g7_metrics_{_level}")(lambda r, level=_level: r.metrics_of(level))
    register(f"g7_metrics_{_level}_all_models", ALL_MODELS)(lambda r, level=_level: r.metrics_of(level))


@register("g8_model_selection")
def _(r: Pipeline) -> DataFrame:
    return B.select_models(r.metrics_of("fold"), r.p.selection_tolerance)


@register("g8_model_selection_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.selection()


@register("g9_holdout_report")
def _(r: Pipeline) -> DataFrame:
    return r.holdout()


@register("g9_holdout_overall")
def _(r: Pipeline) -> DataFrame:
    return r.holdout_overall()


@register("g9_holdout_report_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.holdout()


@register("h7_alert_metrics")
def _(r: Pipeline) -> DataFrame:
    """Sharp weekly drops (alert) against empty weeks ahead (event), per centre."""
    f = features.series_features(r.weekly()).filter(F.col("lag2").isNotNull() & F.col("y").isNotNull())
    return f.groupBy("cedis").agg(*M.alert_metrics(F.col("lag1") < 0.7 * F.col("lag2"), F.col("y") < F.col("scale")))


@register("h8_lead_time")
def _(r: Pipeline) -> DataFrame:
    """Days from the first promoted day to each outlier day in the week after it."""
    days = r.daily()
    return M.lead_time_to_alert(days.filter("promo_flag = 1"), days.filter("outlier_flag = 1"), 7)


@register("i1_split_folds")
def _(r: Pipeline) -> DataFrame:
    return B.split_folds(r.backtest(), r.p.horizon)


@register("i2_blind_overall")
def _(r: Pipeline) -> DataFrame:
    return r.blind_overall()


@register("i2_blind_overall_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.blind_overall()


@register("i2_blind_by_cluster")
def _(r: Pipeline) -> DataFrame:
    return r.blind_cluster()


@register("i2_blind_preselection")
def _(r: Pipeline) -> DataFrame:
    return r.preselection()


@register("i3_blind_regret")
def _(r: Pipeline) -> DataFrame:
    return r.blind_regret()


@register("i3_blind_regret_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.blind_regret()


@register("i4_weighted_means")
def _(r: Pipeline) -> DataFrame:
    return B.blind_weighted(r.blind_regret())


# ------------------------------------------------------------------ forecast
@register("j1_forecast_naive_models")
@register("j1_forecast_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.forecast_all()


@register("j2_selected_forecast")
def _(r: Pipeline) -> DataFrame:
    return r.forecast("final")


@register("j3_risk_origin_forecast")
def _(r: Pipeline) -> DataFrame:
    return r.forecast("risk_eval")


@register("j2_selected_forecast_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.forecast("final")


# ------------------------------------------------------------------ lognormal maths
@register("k_lognormal_maths")
def _(r: Pipeline) -> DataFrame:
    """Parameters, tail, quantile, mean and shortfall for every forecast row against the stock."""
    rows = r.forecast("final").join(r.series().select(*SERIES, "on_hand_as_of"), list(SERIES))
    mu, sigma = dist.lognormal_params(F.col("q50"), F.col("q90"))
    m, s, stock = F.col("mu"), F.col("sigma"), F.coalesce("on_hand_as_of", F.lit(0.0)) / 10
    fitted = rows.select(*SERIES, "h", mu.alias("mu"), sigma.alias("sigma"), stock.alias("stock")).withColumns({
        "mean": dist.mean(m, s), "q_service": dist.quantile(m, s, dist.normal_quantile_of(F.lit(0.95), {0.95})),
    })
    return dist.with_outcomes(fitted, "stock", "mu", "sigma", exceeds="p_exceeds", shortfall="shortfall")


# ------------------------------------------------------------------ risk
@register("l1_weekday_shares")
def _(r: Pipeline) -> DataFrame:
    return R.weekday_shares(r.daily(), r.p.risk_origin + timedelta(days=6))


@register("l2_daily_forecast")
def _(r: Pipeline) -> DataFrame:
    inv = r.inventory_cedis()
    start, end = inv.agg(F.min("date")).scalar(), inv.agg(F.date_add(F.max("date"), 7)).scalar()
    return R.daily_forecast(r.forecast("risk_eval"), r.daily(), r.p.risk_origin + timedelta(days=6), start, end)


@register("l3_forward_demand")
def _(r: Pipeline) -> DataFrame:
    inv = r.inventory_cedis()
    start, end = inv.agg(F.min("date")).scalar(), inv.agg(F.date_add(F.max("date"), 7)).scalar()
    return R.forward_demand(R.daily_forecast(r.forecast("risk_eval"), r.daily(), r.p.risk_origin + timedelta(days=6), start, end))


@register("l4_score_days")
def _(r: Pipeline) -> DataFrame:
    return r.score_window()


@register("l8_isolation_forest")
def _(r: Pipeline) -> DataFrame:
    return r.labeled().select(*SERIES, "date", *R.ANOMALY_FEATURES, "iforest_score", "alert_iforest")


@register("l10_lookahead_labels")
def _(r: Pipeline) -> DataFrame:
    return r.labeled(anomalies=False).select(*SERIES, "date", "stockout_store_share", "event", "label_7d", "episode_onset")


RULES = ("cover", "prob")


@register("l12_method_metrics")
def _(r: Pipeline) -> DataFrame:
    return R.evaluate_methods(r.labeled(anomalies=False), RULES)


@register("l12_method_metrics_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.method_metrics()


@register("l13_threshold_sweep")
def _(r: Pipeline) -> DataFrame:
    return R.threshold_sweep(r.labeled(anomalies=False))


@register("l14_lead_times")
def _(r: Pipeline) -> DataFrame:
    return R.lead_time_table(r.labeled(anomalies=False), RULES)


@register("l16_alert_list")
def _(r: Pipeline) -> DataFrame:
    return r.alerts(anomalies=False)


@register("l16_alert_list_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.alerts()


# all three alert methods on the forecasts of the naive models
register("l12_three_methods")(lambda r: r.method_metrics())
register("l14_three_methods")(lambda r: R.lead_time_table(r.labeled()))
register("l16_three_methods")(lambda r: r.alerts())
register("o3_three_methods")(lambda r: RP.alert_activity(r.labeled(), R.METHODS))


# ------------------------------------------------------------------ orders
@register("m1_moq_rounding")
def _(r: Pipeline) -> DataFrame:
    joined = r.weekly().filter("y is not null")
    return joined.select(*SERIES, "week_start", (F.col("y") - 100).alias("qty"), "moq", O.moq_round_up(F.col("y") - 100, F.col("moq")).alias("order_qty"))


@register("m2_protection_demand")
def _(r: Pipeline) -> DataFrame:
    return O.protection_demand(r.forecast("final"), r.series())


@register("m3_naive_demands")
def _(r: Pipeline) -> DataFrame:
    return O.naive_demands(r.weekly(), r.series(), r.p.last_week)


@register("m4_unit_prices")
def _(r: Pipeline) -> DataFrame:
    return O.unit_prices(r.weekly(), r.p.last_week)


@register("m5_projected_stock")
def _(r: Pipeline) -> DataFrame:
    return O.projected_stock(r.series(), r.daily(), r.p.as_of, r.p.last_week + timedelta(weeks=1))


@register("m14_order_file")
def _(r: Pipeline) -> DataFrame:
    return O.order_file(O.build_orders(r.forecast("final"), r.series(), r.weekly(), r.daily(), r.p))


@register("m14_order_file_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return O.order_file(r.orders())


@register("m15_order_summary")
def _(r: Pipeline) -> DataFrame:
    return O.summarize(r.orders())


@register("m15_order_summary_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.order_summary()


# ------------------------------------------------------------------ quality gates
for _area, _first in {"data": "n1", "forecast": "n6", "blind": "n19", "risk": "n22", "orders": "n29"}.items():
    register(f"{_first}_{_area}_gates")(lambda r, area=_area: G.scorecard(r.gates(area, anomalies=False)))


@register("n40_scorecard")
def _(r: Pipeline) -> DataFrame:
    return r.scorecard(anomalies=False)


@register("n40_scorecard_counts")
def _(r: Pipeline) -> DataFrame:
    return G.status_counts(r.scorecard(anomalies=False))


@register("n40_scorecard_all_models", ALL_MODELS)
def _(r: Pipeline) -> DataFrame:
    return r.scorecard()


# ------------------------------------------------------------------ reporting
_REPORTS = {
    "o1_accuracy_pivot": lambda r: RP.accuracy_pivot(r.metrics_of("cluster"), NAIVE_MODELS),
    "o2_calibration_pivot": lambda r: RP.calibration_pivot(r.calibration()),
    "o3_silent_stockouts": lambda r: RP.silent_stockouts(r.labeled(anomalies=False), RULES),
    "o3_alert_activity": lambda r: RP.alert_activity(r.labeled(anomalies=False), RULES),
    "o4_value_counts": lambda r: RP.value_counts(r.series(), r.alerts(anomalies=False), r.orders()),
    "o5_days_on_hand": lambda r: RP.portfolio_days_on_hand(r.orders()),
    "o6_wape_by_horizon": lambda r: RP.wape_by_horizon(r.metrics_of("cluster_h")),
    "o7_coverage_by_model": lambda r: RP.coverage_by_model(r.holdout()),
    "o8_cluster_forecast_vs_actual": lambda r: RP.cluster_forecast_vs_actual(r.backtest(), r.weekly(), r.selection()),
    "o9_residual_quantiles": lambda r: RP.residual_quantiles(r.backtest(), r.selection()),
    "o9_residual_histogram": lambda r: RP.residual_histogram(r.backtest(), r.selection()),
    "o10_cover_by_label": lambda r: RP.cover_by_label(r.labeled(anomalies=False)),
    "o11_timeline_ranking": lambda r: RP.timeline_ranking(r.labeled(anomalies=False)),
    "o12_representative_series": lambda r: RP.representative_history(r.series(), r.weekly(), r.p.last_week),
    "o13_portfolio_outlook": lambda r: RP.portfolio_outlook(r.weekly(), r.forecast("final")),
    "o14_cluster_weeks": lambda r: RP.cluster_weeks(r.weekly()),
    "o15_promo_lift": lambda r: RP.promo_lift(r.daily()),
    "o15_promo_summary": lambda r: RP.promo_summary(r.daily()),
    "o16_weekday_index": lambda r: RP.weekday_index(r.daily()),
    "o17_calendar_effects": lambda r: RP.calendar_effects(r.daily()),
    "o18_describe_series": lambda r: RP.describe(r.series(), ["n_weeks", "mean_weekly", "on_hand_as_of"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}),
    "o18_describe_shortage": lambda r: RP.describe(r.inventory_cedis(), ["stockout_store_share"], {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}),
    "o19_short_series": lambda r: RP.short_series(r.inventory_cedis()),
    "o19_discontinued": lambda r: RP.discontinued_list(r.series()),
    "o20_top_orders": lambda r: RP.top_orders(r.orders()),
    "o20_high_alerts": lambda r: RP.high_alerts(r.alerts(anomalies=False)).select(*SERIES, "cluster", "cover_days", "p_stockout_7d"),
    "o21_error_reduction": lambda r: RP.error_reduction(r.metrics_of("overall")),
    "o22_selected_metrics": lambda r: RP.selected_rows(r.metrics_of("cluster"), r.selection()),
    "o23_best_naive": lambda r: RP.best_naive(r.metrics_of("overall")),
    "o24_series_with_events": lambda r: RP.event_series_count(r.labeled(anomalies=False)),
}
for _name, _report in _REPORTS.items():
    register(_name)(_report)


# the same with the smoothing model among the choices, checked like the others
THREE_MODELS = ("ma4", "seasonal_naive", "ets")
for _name in oracle.THREE_MODELS:
    register(f"{_name.removesuffix('_naive_models')}_three_models", THREE_MODELS)(FUNCTIONS[_name])


# ------------------------------------------------------------------ contract
def entry(spark: SparkSession) -> DataFrame:
    """What should each centre order next week? Sales to order lines on the smallest tables, moving average only."""
    r = Pipeline(spark, "/root/testdata/sf0.001", grain="flag_all", models=("ma4",))
    return rounded(O.order_file(r.orders()))


def corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus operators and their pipeline; none where these are not installed."""
    try:
        import corpus_pipeline
        from stockweave.llm import queries as llm
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "stockweave.llm"):
            raise
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, {**llm.ORACLE_SQL, **sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **corpus()[0]}


def oracle_sql() -> dict[str, str]:
    return {**{name: sql for name, sql in oracle.QUERIES.items() if name in QUERIES}, **corpus()[1]}
