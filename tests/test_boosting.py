from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.models import features, gbt
from stockweave.params import LEVELS, QCOLS
from tests.util import frame

FIRST = date(2000, 1, 3)
SMALL = gbt.GbtSettings(rounds=3, trees=2, depth=2, rows_per_leaf=5)


def weekly(spark, series):
    """Rows of (upc, cedis) -> weekly values; a value None is an unobserved week."""
    rows = [
        (u, c, FIRST + timedelta(weeks=i), y, y, 10.0, 0.0, 0, i, "A-X" if u % 2 else "C-Z", "A" if u % 2 else "C", "X" if u % 2 else "Z")
        for (u, c), ys in series.items() for i, y in enumerate(ys)
    ]
    return frame(spark, rows, "upc long, cedis string, week_start date, y double, y_capped double, price_mean double, promo_share double, zero_days long, series_age_weeks int, cluster string, abc_class string, xyz_class string")


def calendar(w):
    weeks = w.select("week_start").distinct()
    return weeks.unionByName(weeks.select(F.date_add("week_start", 56).alias("week_start"))).distinct().select("week_start", *[F.weekofyear("week_start").alias(c) for c in features.CALENDAR_COLS])


def forecast(spark, series, tasks, settings=SMALL, parts=None, horizon=2):
    w = weekly(spark, series)
    w = w.repartition(parts) if parts else w
    staged = {}
    def stage(name, build):
        return staged.setdefault(name, build().cache())
    out = gbt.gbt_quantiles(features.horizon_rows(w, calendar(w), horizon), w, tasks, stage, settings)
    return {(r.label, r.fold, r.upc, r.cedis, r.h): tuple(r[q] for q in QCOLS) for r in out.collect()}


def noise(seed, n, level=100.0):
    return [float(x) for x in np.random.default_rng(seed).gamma(20, level / 20, n)]


def origin(week):
    return FIRST + timedelta(weeks=week)


def test_a_week_counts_at_its_origin_and_not_before(spark):
    series = {(u, "A"): noise(u, 60) for u in (1, 2, 3)}
    tasks = [gbt.Task("back", 0, origin(40), 1), gbt.Task("back", 1, origin(50), 1), gbt.Task("final", 0, origin(59), 1)]
    base = forecast(spark, series, tasks)
    changed = {k: [*v[:46], *[x * 3 for x in v[46:51]], *v[51:]] for k, v in series.items()}
    other = forecast(spark, changed, tasks)
    assert {k: v for k, v in base.items() if k[:2] == ("back", 0)} == {k: v for k, v in other.items() if k[:2] == ("back", 0)}
    assert all(base["back", 1, u, "A", 1] != other["back", 1, u, "A", 1] for u in (1, 2, 3))
    newest = forecast(spark, {k: [*v[:59], v[59] * 5] for k, v in series.items()}, tasks)
    assert {k: v for k, v in base.items() if k[0] == "back"} == {k: v for k, v in newest.items() if k[0] == "back"}
    assert base["final", 0, 1, "A", 1] != newest["final", 0, 1, "A", 1]


def test_the_same_model_however_the_rows_are_dealt(spark):
    series = {(u, c): noise(u * 7 + ord(c), 50) for u in (1, 2) for c in "AR"}
    tasks = [gbt.Task("final", 0, origin(49), 1)]
    assert forecast(spark, series, tasks, parts=1) == forecast(spark, series, tasks, parts=7)


def test_quantiles_are_sorted_and_follow_what_the_features_tell(spark):
    # sales alternate between two levels, so the last week tells the next one
    rng = np.random.default_rng(3)
    series = {(u, "A"): [float((50 if (i + u) % 2 else 150) * rng.uniform(0.9, 1.1)) for i in range(90)] for u in range(1, 7)}
    got = forecast(spark, series, [gbt.Task("final", 0, origin(89), 26)], gbt.GbtSettings(rounds=12, trees=4, depth=3, rows_per_leaf=10), horizon=1)
    for (_, _, u, _, _), q in got.items():
        assert list(q) == sorted(q) and q[2] == pytest.approx(50 if (90 + u) % 2 else 150, rel=0.2)
        assert q[4] - q[0] < 60


def test_series_with_too_few_weeks_teach_nothing_but_get_a_forecast(spark):
    series = {(1, "A"): noise(1, 60), (2, "A"): [None] * 50 + noise(2, 10)}
    tasks = [gbt.Task("back", 0, origin(59), 26)]
    base = forecast(spark, series, tasks)
    other = forecast(spark, {**series, (2, "A"): [*series[2, "A"][:-1], 1e6]}, tasks)
    assert base["back", 0, 1, "A", 1] != base["back", 0, 2, "A", 1] and base["back", 0, 2, "A", 1][2] > 0
    rows = {(u, c): [None] * 60 for u, c in series}
    assert all(q is None for v in forecast(spark, rows, tasks).values() for q in v)
    assert len(other) == len(base)


def test_best_split_equals_a_search_through_the_rows():
    rng = np.random.default_rng(5)
    n, columns = 400, np.array([3, 8, 11])
    bins, node, y_class = rng.integers(0, gbt.BINS, (3, n)), rng.integers(0, 2, n), rng.integers(0, gbt.N_LEVELS + 1, n)
    y_class[bins[1] > 20] = 0
    counts = np.zeros((2, 3, gbt.BINS, gbt.N_LEVELS + 1), dtype=np.int64)
    for c in range(3):
        np.add.at(counts, (node, c, bins[c], y_class), 1)
    s = gbt.GbtSettings(rows_per_leaf=10)
    grad = np.array([[(level >= gbt.N_LEVELS - k) - q for level, q in enumerate(LEVELS)] for k in y_class])
    weight = 1 / (np.array(LEVELS) * (1 - np.array(LEVELS)))
    score = lambda rows: (grad[rows].sum(axis=0) ** 2 * weight).sum() / (rows.sum() + s.shrink)
    best = max(
        ((sum(score(mine & (bins[c] <= b)) + score(mine & (bins[c] > b)) - score(mine) for m in (0, 1) if min((mine := node == m)[bins[c] <= b].sum(), mine[bins[c] > b].sum()) >= 10), -c, -b)
         for c in range(3) for b in range(gbt.BINS - 1)))
    assert gbt.best_split(counts, columns, s) == (int(columns[-best[1]]), -best[2])
    assert gbt.best_split(counts * 0, columns, s) is None


def test_leaves_hold_residual_quantiles():
    rng = np.random.default_rng(6)
    r = rng.normal(0.3, 0.5, 20_000)
    counts = np.bincount(np.searchsorted(gbt.GRID, r), minlength=len(gbt.GRID) + 1)
    got = gbt.leaf_values(np.tile(counts, (1, gbt.N_LEVELS, 1)), 0.0)[0]
    assert got == pytest.approx(np.quantile(r, LEVELS), abs=0.02)
    assert (gbt.leaf_values(np.zeros((1, gbt.N_LEVELS, len(gbt.GRID) + 1), dtype=np.int64), 10.0) == 0).all()


def test_more_models_than_bits_are_refused(spark):
    w = weekly(spark, {(1, "A"): noise(1, 10)})
    with pytest.raises(ValueError, match="63"):
        gbt.gbt_quantiles(w, w, [gbt.Task("x", i, FIRST, 1) for i in range(64)], lambda n, b: b())


def test_target_statistics_hold_only_earlier_weeks(spark):
    series = {(1, "A"): noise(1, 30), (1, "R"): noise(2, 30), (3, "A"): noise(3, 30)}
    w = weekly(spark, series)
    rows = {(r.upc, r.cedis, r.week_start): r for r in features.target_statistics(features.series_features(w)).collect()}
    scale = lambda ys, i: max(np.mean(ys[max(0, i - 12): i + 1]), 1.0) if i >= 3 else None
    ratios = {k: {i: ys[i] / scale(ys, i - 1) for i in range(30) if scale(ys, i - 1) is not None} for k, ys in series.items()}
    week, m = 20, features.STAT_WEIGHT
    past = lambda keep: [r for k, v in ratios.items() if keep(k) for i, r in v.items() if i < week]
    every = past(lambda k: True)  # all products are of one cluster
    prior = (sum(every) + m) / (len(every) + m)
    for (u, c) in series:
        got = rows[u, c, origin(week)]
        mine, centre = past(lambda k: k[0] == u), past(lambda k: k[1] == c)
        assert got.upc_stat == pytest.approx((sum(mine) + m * prior) / (len(mine) + m))
        assert got.cedis_stat == pytest.approx((sum(centre) + m * prior) / (len(centre) + m))
    assert rows[1, "A", origin(0)].upc_stat == 1.0
