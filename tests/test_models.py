from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.models import ets, features, gbt, iforest, naive
from stockweave.models.future import eligible_series, with_folds
from stockweave.params import QCOLS
from tests.util import frame

ORIGIN = date(2025, 12, 29)


def weekly(spark, values: dict[int, list], end: date = ORIGIN):
    rows = []
    for upc, ys in values.items():
        start = end - timedelta(weeks=len(ys) - 1)
        rows += [(upc, "X", start + timedelta(weeks=i), y, y, 10.0, 0.0, 0, i, "A-X", "A", "X") for i, y in enumerate(ys)]
    schema = "upc long, cedis string, week_start date, y double, y_capped double, price_mean double, promo_share double, zero_days long, series_age_weeks int, cluster string, abc_class string, xyz_class string"
    return frame(spark, rows, schema)


def by_step(df):
    return {(r.upc, r.fold, r.h): r for r in df.collect()}


def brute_moving_average(y, h):
    y = np.array([np.nan if v is None else v for v in y], dtype=float)
    seen = y[~np.isnan(y)]
    point = seen[-4:].mean() if len(seen) else 0.0
    resid = []
    for t in range(len(y)):
        past = y[max(t - h - 3, 0) : max(t - h + 1, 0)]
        past = past[~np.isnan(past)]
        if len(past) and not np.isnan(y[t]):
            resid.append(y[t] - past.mean())
    qs = [point + np.quantile(resid, q) if len(resid) >= 8 else point * (1 + q - 0.5) for q in (0.05, 0.1, 0.5, 0.9, 0.95)]
    qs[2] = point
    return np.sort(np.clip(qs, 0, None))


def test_moving_average_against_brute_force(spark):
    rng = np.random.default_rng(3)
    long = [None if i % 11 == 3 else float(v) for i, v in enumerate(rng.gamma(3, 20, 60))]
    data = {1: long, 2: [5.0, 7.0, 9.0], 3: [None] * 4}
    earlier = ORIGIN - timedelta(weeks=6)
    got = by_step(naive.moving_average(weekly(spark, data), [earlier, ORIGIN], 8))
    for fold, cut in ((0, 6), (1, 0)):
        for h in (1, 4, 8):
            r = got[(1, fold, h)]
            assert [r[q] for q in QCOLS] == pytest.approx(brute_moving_average(long[: len(long) - cut], h))
    assert [got[(2, 1, 1)][q] for q in QCOLS] == pytest.approx([7 * f for f in (0.55, 0.6, 1.0, 1.4, 1.45)])
    assert got[(3, 1, 1)].q50 == 0.0
    assert got[(1, 1, 3)].target_week == ORIGIN + timedelta(weeks=3)


def test_seasonal_naive_uses_last_year_else_last_value(spark):
    ys = [float(i % 52) + 1 for i in range(60)]
    ys[60 - 52 + 1] = None
    got = by_step(naive.seasonal_naive(weekly(spark, {1: ys, 2: [3.0, 4.0]}), [ORIGIN], 4))
    assert got[(1, 0, 1)].q50 == 9.0 and got[(1, 0, 2)].q50 == 8.0 and got[(1, 0, 3)].q50 == 11.0
    assert got[(2, 0, 1)].q50 == 4.0


def test_gaps_interpolate_with_what_the_origin_knows(spark):
    w = weekly(spark, {1: [None, 2.0, None, None, 8.0, None]})
    early = ORIGIN - timedelta(weeks=2)
    filled = with_folds(ets.interpolate_gaps(w, "y_capped"), [early, ORIGIN]).withColumn("v", ets.interpolated_value(F.col("origin")))
    got = {f: [r.v for r in filled.filter(F.col("fold") == f).orderBy("week_start").collect()] for f in (0, 1)}
    assert got[1] == pytest.approx([2, 2, 4, 6, 8, 8])
    assert got[0] == pytest.approx([2, 2, 2, 2])


def test_damped_trend_follows_level_and_trend(spark):
    flat = [50.0] * 30
    ramp = [10.0 + 2 * i for i in range(40)]
    got = by_step(ets.ets_damped(weekly(spark, {1: flat, 2: ramp, 3: [5.0] * 4}), [ORIGIN], 8))
    assert [got[(1, 0, h)].q50 for h in (1, 8)] == [50.0, 50.0] and got[(1, 0, 1)].q05 == 50.0
    assert 88 < got[(2, 0, 1)].q50 < 92 and got[(2, 0, 8)].q50 > got[(2, 0, 1)].q50
    assert got[(2, 0, 8)].q95 - got[(2, 0, 8)].q05 >= got[(2, 0, 1)].q95 - got[(2, 0, 1)].q05
    assert got[(3, 0, 2)].q50 == 5.0


def test_damped_trend_matches_a_plain_recursion(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(100, 15, 50)
    r = ets.fit(weekly(spark, {1: [float(v) for v in y]}), [ORIGIN]).collect()[0]
    best = None
    for a, b, p in ets.GRID:
        tr = (y[5:10].mean() - y[:5].mean()) / 5
        level, sse = y[:10].mean() - 5.5 * tr, 0.0
        for v in y:
            base = level + p * tr
            e = v - base
            sse, level, tr = sse + e * e, base + a * e, p * tr + b * e
        best = min(best or (np.inf,), (sse, a, b, p, level, tr))
    assert (r.sse, r.alpha, r.beta, r.phi, r.level, r.trend) == pytest.approx(best)


def test_features_scale_lags_and_last_year(spark):
    ys = [float(100 + i) for i in range(70)]
    w = weekly(spark, {1: ys})
    cal = w.select("week_start").distinct().select("week_start", *[F.lit(0).alias(c) for c in features.CALENDAR_COLS])
    rows = features.horizon_rows(w, cal, 8)
    last = {r.h: r for r in features.inference(rows, ORIGIN).collect()}
    scale = np.mean(ys[-13:])
    assert last[1].scale == pytest.approx(scale) and last[1].lag1 == pytest.approx(ys[-1] / scale) and last[1].lag8 == pytest.approx(ys[-8] / scale)
    assert last[3].lag52_target == pytest.approx(ys[70 - 52 + 2] / scale) and last[3].y_target is None
    sup = features.supervised(rows)
    # scale needs four weeks; every later week with an observed target counts
    assert sup.filter("h = 1").count() == 70 - 3 - 1 and sup.filter("h = 8").count() == 70 - 3 - 8


def test_eligible_series_needs_enough_weeks(spark):
    train = with_folds(weekly(spark, {1: [1.0] * 26, 2: [1.0] * 25 + [None]}), [ORIGIN])
    assert [r.upc for r in eligible_series(train, 26).collect()] == [1]


def test_isolation_forest_ranks_the_odd_row_first_whatever_the_partitioning(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(999, 9.0, -9.0)]
    df = frame(spark, rows, "id long, a double, b double")
    first = {r.id: r.iforest_score for r in iforest.isolation_scores(df.repartition(1), ["a", "b"], ["id"], n_trees=30).collect()}
    second = {r.id: r.iforest_score for r in iforest.isolation_scores(df.repartition(5), ["a", "b"], ["id"], n_trees=30).collect()}
    assert first == second
    assert max(first, key=first.get) == 999 and 0 < min(first.values()) and max(first.values()) < 1


def smoothed_error(ys, alpha, beta, phi):
    t = (np.mean(ys[5:10]) - np.mean(ys[:5])) / 5
    level = np.mean(ys[:10]) - 5.5 * t
    sse = 0.0
    for y in ys:
        base = level + phi * t
        err = y - base
        sse += err * err
        level, t = base + alpha * err, phi * t + beta * err
    return sse


def test_steps_never_raise_the_error_of_the_grid_and_come_near_the_least(spark):
    rng = np.random.default_rng(11)
    values = {
        1: list(100 + np.cumsum(rng.normal(size=80))), 2: list(rng.gamma(5, 20, 60)), 3: list(50 + 2.0 * np.arange(70) + rng.normal(scale=3, size=70)),
        4: [10.0] * 30 + [200.0] * 30, 5: list(rng.normal(1000, 1e-3, 40)), 6: [0.0] * 39 + [1.0],
    }
    got = {r.upc: r for r in ets.fit(weekly(spark, values), [ORIGIN]).collect()}
    fine = [(a, a * b, p) for a in np.linspace(0.01, 0.99, 25) for b in (0.001, 0.05, 0.2, 0.5, 1.0) for p in (0.8, 0.9, 0.98)]
    for upc, ys in values.items():
        r = got[upc]
        on_grid = min(smoothed_error(ys, *g) for g in ets.GRID)
        assert r.sse == pytest.approx(smoothed_error(ys, r.alpha, r.beta, r.phi), rel=1e-9)
        assert r.sse <= on_grid * (1 + 1e-12) and r.sse <= min(smoothed_error(ys, *g) for g in fine) * 1.03
        assert 0.001 <= r.alpha <= 0.99 and 0 < r.beta <= r.alpha and 0.8 <= r.phi <= 0.98
    assert got[1].alpha > 0.7 and got[1].sse < min(smoothed_error(values[1], *g) for g in ets.GRID)


def test_a_fit_at_an_origin_knows_only_its_history(spark):
    rng = np.random.default_rng(12)
    ys = [float(x) for x in 100 + np.cumsum(rng.normal(size=60))]
    earlier = ORIGIN - timedelta(weeks=10)
    both = {r.fold: r for r in ets.fit(weekly(spark, {1: ys}), [earlier, ORIGIN]).collect()}
    alone = ets.fit(weekly(spark, {1: ys[:50]}, end=earlier), [earlier]).first()
    assert (both[0].sse, both[0].alpha, both[0].level) == (alone.sse, alone.alpha, alone.level)


def test_forest_samples_are_the_rows_with_the_least_tickets(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, [(i, float(x)) for i, x in enumerate(rng.normal(size=5000))], "id long, a double").repartition(6)
    numbered = df.select("id", *iforest.row_numbers(["id"]), iforest.whole(F.col("a")).alias("_f_a"))
    rows = numbered.collect()
    names = ["_f_a"]
    schema = "tree int, ticket long, _f_a long"
    sent = numbered.drop("id").mapInArrow(iforest._sampled(names, 42, 3, combine=False), schema)
    kept = sent.repartition(2, "tree").mapInArrow(iforest._sampled(names, 42, 3, combine=True), schema).collect()
    for tree, (a, b, c, d) in enumerate(iforest.permutations(42, 3)):
        tickets = sorted(((((r._h1 * a + b) % iforest.PRIME) << 31) + (r._h2 * c + d) % iforest.PRIME, r._f_a) for r in rows)
        assert [(r.ticket, r._f_a) for r in sorted(kept, key=lambda r: r.ticket) if r.tree == tree] == tickets[: iforest.SAMPLE_ROWS]


def test_forest_with_few_equal_and_missing_rows(spark):
    schema = "id long, a double, b double"
    assert iforest.isolation_scores(frame(spark, [], schema), ["a"], ["id"]).collect() == []
    one = iforest.isolation_scores(frame(spark, [(1, 2.0, None)], schema), ["a", "b"], ["id"], n_trees=5).collect()
    assert len(one) == 1 and 0 < one[0].iforest_score <= 1
    same = iforest.isolation_scores(frame(spark, [(i % 3, 1.0, None) for i in range(50)], schema), ["a", "b"], ["id"], n_trees=5).collect()
    assert len({r.iforest_score for r in same}) == 1
