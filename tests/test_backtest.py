from datetime import date, timedelta

import numpy as np

from stockweave.params import QCOLS, Params
from stockweave.plans import backtest as B
from tests.util import frame

SCHEMA = "model string, cluster string, y double, q05 double, q10 double, q50 double, q90 double, q95 double"


def pred(spark, width: float):
    y = np.random.default_rng(0).normal(100, 10, 4000)
    return frame(spark, [("m", "c", float(v), 100 - 1.645 * width, 100 - 1.28 * width, 100.0, 100 + 1.28 * width, 100 + 1.645 * width) for v in y], SCHEMA)


def test_origins_leave_a_full_horizon():
    p = Params()
    o = p.fold_origins()
    assert len(o) == p.folds and o[-1] + timedelta(weeks=p.horizon) == p.last_week
    assert {(b - a).days for a, b in zip(o, o[1:])} == {7 * p.step_weeks} and all(x.weekday() == 0 for x in o)


def test_calibration_widens_narrow_and_narrows_wide_intervals(spark):
    narrow, wide = pred(spark, 3.0), pred(spark, 30.0)
    k_narrow, k_wide = B.calibrate_intervals(narrow), B.calibrate_intervals(wide)
    assert all(r.k > 0 for r in k_narrow.collect()) and all(r.k < 0 for r in k_wide.collect())
    rows = B.apply_calibration(narrow, k_narrow).collect()
    assert 0.76 <= np.mean([r.q10 <= r.y <= r.q90 for r in rows]) <= 0.84
    assert 0.86 <= np.mean([r.q05 <= r.y <= r.q95 for r in rows]) <= 0.94
    assert all(r.q05 <= r.q10 <= r.q50 <= r.q90 <= r.q95 and r.q50 == 100.0 for r in rows)
    assert set(QCOLS) <= set(rows[0].asDict())


def test_selection_prefers_the_steadier_model_within_tolerance(spark):
    rows = [("c", "gbt", f, [0.1, 0.2, 0.1, 0.2][f], 0.0, 0.9) for f in range(4)] + [("c", "ets", f, 0.16, 0.0, 0.9) for f in range(4)]
    sel = B.select_models(frame(spark, rows, "cluster string, model string, fold int, wape double, bias double, coverage_90 double")).collect()[0]
    assert sel.selected_model == "ets" and "lower fold spread" in sel.rationale


def test_selection_with_one_fold_falls_back_to_the_simpler_model(spark):
    rows = [("c", m, 0, 0.15, 0.0, 0.9) for m in ("ets", "ma4")]
    sel = B.select_models(frame(spark, rows, "cluster string, model string, fold int, wape double, bias double, coverage_90 double")).collect()[0]
    assert sel.selected_model == "ma4" and sel.wape_std is None


def test_split_folds_drops_overlapping_folds(spark):
    df = frame(spark, [(0, date(2025, 12, 8)), (1, date(2026, 1, 5)), (2, date(2026, 2, 2))], "fold int, origin date")
    assert {r.fold: r.role for r in B.split_folds(df, 8).collect()} == {0: "usable", 1: "overlap", 2: "sealed"}


def test_regret_is_never_negative(spark):
    m = frame(spark, [("c", "ma4", 0.2, 0.9, 5), ("c", "ets", 0.1, 0.9, 5)], "cluster string, model string, wape double, coverage_90 double, n long")
    r = B.blind_regret(m, frame(spark, [("c", "ma4")], "cluster string, selected_model string")).collect()[0]
    assert r.best_model_in_hindsight == "ets" and abs(r.regret - 0.1) < 1e-12 and not r.choice_held
