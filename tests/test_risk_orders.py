from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from stockweave.functions import dist
from stockweave.operators import orders as O
from stockweave.operators import risk as R
from tests.util import days, frame


def test_normal_cdf(spark):
    xs = [-9.0, -7.2, -3.0, -1.0, -0.1, 0.0, 0.4, 1.2815515655446004, 2.5, 6.0, 8.0]
    got = frame(spark, [(x,) for x in xs], "x double").select("x", dist.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=2e-12)


def test_lognormal_fit_recovers_its_quantiles(spark):
    mu, sigma = dist.lognormal_params(F.lit(100.0), F.lit(150.0))
    r = spark.range(1).select(dist.quantile(mu, sigma, F.lit(0.0)).alias("q50"), dist.quantile(mu, sigma, F.lit(NormalDist().inv_cdf(0.9))).alias("q90")).collect()[0]
    assert r.q50 == pytest.approx(100.0) and r.q90 == pytest.approx(150.0, rel=1e-6)


def test_probability_and_shortfall_fall_with_stock(spark):
    mu, sigma = dist.lognormal_params(F.lit(100.0), F.lit(160.0))
    df = frame(spark, [(0.0,), (100.0,), (400.0,)], "stock double").select("stock", mu.alias("m"), sigma.alias("s"))
    rows = dist.with_outcomes(df, "stock", "m", "s", exceeds="p", shortfall="lost").withColumn("mean", dist.mean(F.col("m"), F.col("s"))).orderBy("stock").collect()
    assert rows[0].p == 1.0 and rows[1].p == pytest.approx(0.5, abs=1e-6) and rows[2].p < 0.01
    assert rows[0].lost == pytest.approx(rows[0]["mean"]) and rows[0].lost > rows[1].lost > rows[2].lost >= 0
    plain = df.select(dist.prob_demand_exceeds(F.col("stock"), F.col("m"), F.col("s")).alias("p"), dist.expected_shortfall(F.col("stock"), F.col("m"), F.col("s")).alias("lost"), "stock").orderBy("stock").collect()
    assert [x for r in plain for x in (r.p, r.lost)] == pytest.approx([x for r in rows for x in (r.p, r.lost)])


def test_weekday_shares_drive_the_daily_forecast(spark):
    past = days("2026-01-05", 70)
    daily = frame(spark, [(1, "X", d, 70.0 if d.weekday() == 5 else 0.0) for d in past], "upc long, cedis string, date date, sell_out_pzs double")
    fc = frame(spark, [(1, "X", date(2026, 3, 16), 700.0, 900.0)], "upc long, cedis string, target_week date, q50 double, q90 double")
    got = {r.date: r for r in R.daily_forecast(fc, daily, date(2026, 3, 15), date(2026, 3, 14), date(2026, 3, 30)).collect()}
    assert got[date(2026, 3, 21)].d50 == pytest.approx(700.0) and got[date(2026, 3, 18)].d50 == 0.0
    assert got[date(2026, 3, 14)].d50 == pytest.approx(700.0)  # before the first forecast week: borrows it
    assert got[date(2026, 3, 28)].d50 is None  # beyond the horizon


def test_shares_fall_back_to_a_seventh(spark):
    daily = frame(spark, [(1, "X", d, 0.0) for d in days("2026-03-02", 7)] + [(2, "X", date(2026, 3, 2), 5.0)], "upc long, cedis string, date date, sell_out_pzs double")
    got = {(r.upc, r.dow): r.share for r in R.weekday_shares(daily, date(2026, 3, 15)).collect()}
    assert got[(1, 0)] == pytest.approx(1 / 7) and got[(2, 0)] == 1.0 and got[(2, 3)] == pytest.approx(1 / 7)


def test_forward_demand_excludes_today_and_ends_null(spark):
    rows = [(1, "X", d, float(i), 2.0 * i) for i, d in enumerate(days("2026-03-01", 9))]
    got = R.forward_demand(frame(spark, rows, "upc long, cedis string, date date, d50 double, d90 double")).orderBy("date").collect()
    assert got[0].fwd50 == sum(range(1, 8)) and got[7].fwd50 == 8.0 and got[8].fwd50 is None


def test_label_needs_the_full_window(spark):
    rows = [(1, "X", d, 0.5 if d == date(2026, 3, 27) else 0.0) for d in days("2026-03-20", 11)]
    lab = {r.date: r for r in R.label_lookahead(frame(spark, rows, "upc long, cedis string, date date, stockout_store_share double")).collect()}
    assert all(lab[date(2026, 3, d)].label_7d == 1 for d in (20, 21, 23))
    assert lab[date(2026, 3, 24)].label_7d is None
    assert lab[date(2026, 3, 27)].episode_onset and sum(r.episode_onset for r in lab.values()) == 1


def test_event_on_the_first_day_is_no_onset(spark):
    rows = [(1, "X", d, 0.5) for d in days("2026-03-20", 3)]
    assert R.label_lookahead(frame(spark, rows, "upc long, cedis string, date date, stockout_store_share double")).filter("episode_onset").count() == 0


def test_moq_round_up(spark):
    df = frame(spark, [(0.0,), (1.0,), (100.0,), (101.0,), (250.0,), (-5.0,)], "q double")
    assert [r.v for r in df.select(O.moq_round_up(F.col("q"), F.lit(100)).alias("v")).collect()] == [0.0, 100.0, 100.0, 200.0, 300.0, 0.0]


def test_protection_demand_uses_each_series_lead_time(spark):
    fc = frame(spark, [(u, "X", h, *[10.0 * h] * 5) for u in (1, 2) for h in (1, 2, 3)], "upc long, cedis string, h int, q05 double, q10 double, q50 double, q90 double, q95 double")
    series = frame(spark, [(1, "X", 7), (2, "X", 14)], "upc long, cedis string, lead_time_days long")
    got = {r.upc: (r.q50, r.weeks_available) for r in O.protection_demand(fc, series).collect()}
    assert got == {1: (30.0, 2), 2: (60.0, 3)}


def test_last_year_demand_falls_back_to_the_average(spark):
    origin = date(2025, 12, 29)
    rows = [(1, "X", date(2025, 12, d), float(d)) for d in (1, 8, 15, 22, 29)] + [(2, "X", date(2025, 12, 29), 5.0), (2, "X", date(2025, 1, 6), 40.0), (2, "X", date(2025, 1, 13), 60.0)]
    series = frame(spark, [(1, "X", 7), (2, "X", 7)], "upc long, cedis string, lead_time_days long")
    got = {r.upc: r for r in O.naive_demands(frame(spark, rows, "upc long, cedis string, week_start date, y double"), series, origin).collect()}
    assert got[1].ma4_weekly == pytest.approx((8 + 15 + 22 + 29) / 4) and got[1].ly_demand == got[1].ma4_demand
    assert got[2].ly_demand == 100.0


def test_severity_order(spark):
    df = frame(spark, [(0.8, 30.0, 7, False), (0.1, 5.0, 7, False), (0.1, 30.0, 7, True), (0.1, 30.0, 7, False)], "p_stockout_7d double, cover_days double, lead_time_days long, alert_cover boolean")
    assert [r.s for r in df.select(R.severity(("cover",)).alias("s")).collect()] == ["high", "high", "medium", "none"]
