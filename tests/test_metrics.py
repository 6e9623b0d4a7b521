from datetime import date

import pytest
from pyspark.sql import functions as F

from stockweave.functions import metrics as M
from tests.util import frame


def one(df, expr):
    return df.agg(expr.alias("v")).collect()[0].v


def test_wape_and_bias(spark):
    df = frame(spark, [(100.0, 110.0), (200.0, 190.0), (300.0, 330.0)], "y double, p double")
    assert one(df, M.wape(F.col("y"), F.col("p"))) == pytest.approx(50 / 600)
    assert one(df, M.bias(F.col("y"), F.col("p"))) == pytest.approx(30 / 600)
    assert one(df, M.wape(F.col("y"), F.col("y"))) == 0.0


def test_mape_ignores_zero_actuals(spark):
    assert one(frame(spark, [(0.0, 5.0), (100.0, 150.0)], "y double, p double"), M.mape(F.col("y"), F.col("p"))) == pytest.approx(0.5)
    assert one(frame(spark, [(0.0, 1.0)], "y double, p double"), M.mape(F.col("y"), F.col("p"))) is None


def test_pinball_is_asymmetric(spark):
    df = frame(spark, [(10.0, 8.0, 12.0)], "y double, low double, high double")
    assert one(df, M.pinball(F.col("y"), F.col("low"), 0.9)) == pytest.approx(1.8)
    assert one(df, M.pinball(F.col("y"), F.col("high"), 0.9)) == pytest.approx(0.2)


def test_coverage_is_inclusive(spark):
    df = frame(spark, [(1.0,), (5.0,), (10.0,), (20.0,)], "y double")
    assert one(df, M.coverage(F.col("y"), F.lit(0.0), F.lit(10.0))) == 0.75


def test_alert_metrics_counts(spark):
    df = frame(spark, [(True, True), (True, False), (False, True), (False, False), (True, False)], "a boolean, e boolean")
    m = df.agg(*M.alert_metrics(F.col("a"), F.col("e"))).collect()[0]
    assert (m.n, m.n_alerts, m.n_events) == (5, 3, 2)
    assert m.precision == pytest.approx(1 / 3) and m.recall == pytest.approx(0.5) and m.false_alarm_rate == pytest.approx(2 / 3)
    empty = frame(spark, [(False, False)], "a boolean, e boolean").agg(*M.alert_metrics(F.col("a"), F.col("e"))).collect()[0]
    assert empty.precision is None and empty.recall is None and empty.f1 is None


def test_lead_time_takes_the_earliest_alert_in_the_window(spark):
    schema = "upc long, cedis string, date date"
    alerts = frame(spark, [(1, "X", date(2026, 3, d)) for d in (10, 20, 22, 30)], schema)
    events = frame(spark, [(1, "X", date(2026, 3, 25)), (2, "X", date(2026, 3, 25)), (1, "X", date(2026, 3, 20))], schema)
    got = {(r.upc, r.date.day): r.lead_time_days for r in M.lead_time_to_alert(alerts, events, 7).collect()}
    # the alert on the event day itself and those older than a week do not count
    assert got == {(1, 25): 5, (2, 25): None, (1, 20): None}


def test_levels_match_single_groupings(spark):
    rows = [("m", c, f, 10.0 * (f + 1), 5.0, 6.0, 9.0 + f, 30.0, 40.0) for c in ("a", "b") for f in range(4)]
    pred = frame(spark, rows, "model string, cluster string, fold int, y double, q05 double, q10 double, q50 double, q90 double, q95 double")
    levels = M.summarize_levels(pred, {"cluster": ("model", "cluster"), "overall": ("model",)})
    cols = ["n", "wape", "mape", "bias", "pinball", "coverage_90", "coverage_80", "width_rel"]
    for level, keys in (("cluster", ["model", "cluster"]), ("overall", ["model"])):
        want = sorted(map(tuple, M.summarize_forecasts(pred, keys).select(*keys, *cols).collect()))
        got = sorted(map(tuple, levels.filter(F.col("level") == level).select(*keys, *cols).collect()))
        assert [g[: len(keys)] for g in got] == [w[: len(keys)] for w in want]
        assert [x for g in got for x in g[len(keys) :]] == pytest.approx([x for w in want for x in w[len(keys) :]])
