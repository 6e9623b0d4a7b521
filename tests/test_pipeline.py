"""One run with all models on the small tables, and the registered queries' contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stockweave.params import QCOLS, SERIES
from stockweave.plans.pipeline import ALL_MODELS, NAIVE_MODELS, Pipeline

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def done(spark):
    r = Pipeline(spark, SF, models=ALL_MODELS)
    r.run()
    return r


def test_prepare(done):
    weekly, series = done.weekly(), done.series()
    assert series.count() == 18 and weekly.groupBy(*SERIES, "week_start").count().filter("count > 1").isEmpty()
    gaps = weekly.groupBy(*SERIES).agg((F.datediff(F.max("week_start"), F.min("week_start")) / 7 + 1 - F.count(F.lit(1))).alias("g"))
    assert gaps.filter("g <> 0").isEmpty()
    assert weekly.filter("y is not null and days_observed < 5").isEmpty() and weekly.filter("y_capped > y + 1e-9").isEmpty()
    assert done.inventory_cedis().filter("stockout_store_share not between 0 and 1 or on_hand < on_hand_raw").isEmpty()


def test_backtest_scores_every_model_on_the_same_rows(done):
    counts = {r.model: (r.n, r["count"]) for r in done.backtest().groupBy("model").agg(F.count("y").alias("n"), F.count(F.lit(1)).alias("count")).collect()}
    assert set(counts) == set(ALL_MODELS) and len(set(counts.values())) == 1
    bad = done.backtest().filter(" or ".join(f"{a} > {b}" for a, b in zip(QCOLS, QCOLS[1:])) + " or q05 < 0")
    assert bad.isEmpty()


def test_global_model_beats_the_moving_average(done):
    wape = {r.model: r.wape for r in done.metrics_of("overall").collect()}
    assert wape["gbt"] < wape["ma4"] < wape["seasonal_naive"] and wape["ets"] < wape["ma4"]
    coverage = {r.model: r.coverage_90 for r in done.metrics_of("overall").collect()}
    assert all(0.75 < c < 0.99 for c in coverage.values())


def test_forecast_has_one_model_and_a_full_horizon_per_series(done):
    per = done.forecast().groupBy(*SERIES).agg(F.count_distinct("h").alias("h"), F.count_distinct("model").alias("m")).collect()
    assert len(per) == 18 and all((r.h, r.m) == (8, 1) for r in per)


def test_risk_and_orders(done):
    labeled = done.labeled()
    assert labeled.filter("p_stockout_7d not between 0 and 1").isEmpty() and labeled.filter("event").count() > 0
    share = labeled.agg(F.avg(F.col("alert_iforest").cast("int"))).first()[0]
    assert 0.03 < share < 0.07
    orders = done.orders()
    assert orders.count() == 18 and orders.filter("order_qty < 0 or abs(order_qty % moq) > 1e-6").isEmpty()
    assert orders.filter("is_discontinued and order_qty > 0").isEmpty()
    total = done.order_summary().filter("level = 'portfolio'").first()
    for level in ("cluster", "cedis"):
        parts = done.order_summary().filter(F.col("level") == level).agg(F.sum("order_units")).first()[0]
        assert parts == pytest.approx(total.order_units)


def test_scorecard(done):
    card = done.scorecard().collect()
    assert len(card) == 39
    structural = {"n_series", "quantiles_monotone_share", "one_line_per_series", "order_qty_moq_multiple_share", "weekly_duplicate_keys", "methods_evaluated"}
    assert all(r.status == "pass" for r in card if r.gate in structural)


def test_rerun_is_identical(done, spark):
    again = Pipeline(spark, SF, models=("ma4", "seasonal_naive"))
    first = Pipeline(spark, SF, models=("ma4", "seasonal_naive"))
    assert again.orders().select("upc", "cedis", "order_qty", "implied_service_level").exceptAll(first.orders().select("upc", "cedis", "order_qty", "implied_service_level")).isEmpty()


def test_entry_and_query_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.QUERIES, entry.oracle_sql()
    assert set(sql) <= set(entry.queries())
    rows_only = {n for n in queries if n not in sql}
    assert all(n.endswith("_all_models") or n in {"f11_encoded_features", "f12_boosted_quantiles", "l8_isolation_forest"} for n in rows_only)


def test_forecast_of_all_models_has_all_of_them(spark):
    models = lambda name: {r.model for r in entry.QUERIES[name](spark, SF).select("model").distinct().collect()}
    assert models("j1_forecast_all_models") == set(ALL_MODELS) and models("j1_forecast_naive_models") == set(NAIVE_MODELS)
    assert "j1_forecast_all_models" not in entry.oracle_sql() and "j1_forecast_naive_models" in entry.oracle_sql()
