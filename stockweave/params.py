"""Parameters of the pipeline. Every operator takes the ones it needs as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

SERIES = ("upc", "cedis")

# The quantile levels every model emits and the columns that carry them.
LEVELS = (0.05, 0.10, 0.50, 0.90, 0.95)
QCOLS = ("q05", "q10", "q50", "q90", "q95")


@dataclass(frozen=True)
class Params:
    # dates
    first_week: date = date(1995, 1, 2)
    last_week: date = date(2001, 10, 29)
    as_of: date = date(2001, 11, 1)
    risk_origin: date = date(2001, 10, 1)
    calendar_tail_days: int = 70
    # cleaning
    outlier_z: float = 5.0
    outlier_window: int = 56
    outlier_min_obs: int = 14
    clip_negative: bool = True
    event_share: float = 0.25
    min_days_for_week: int = 5
    # forecast and backtest
    horizon: int = 8
    folds: int = 8
    step_weeks: int = 4
    holdout_folds: int = 3
    cold_start_weeks: int = 26
    selection_tolerance: float = 0.02
    seed: int = 42
    # risk
    lookahead_days: int = 7
    prob_threshold: float = 0.5
    contamination: float = 0.05
    # orders
    review_days: int = 7
    cost_ratio: float = 1.0
    service_levels: dict[str, float] = field(default_factory=lambda: {"A": 0.95, "B": 0.90, "C": 0.85})
    # quality gates
    max_weekly_missing_share: float = 0.02
    min_series_with_inventory_share: float = 0.95
    max_wape_selected: float = 0.25
    min_rel_improvement_vs_naive: float = 0.05
    max_abs_bias: float = 0.10
    coverage_90_range: tuple[float, float] = (0.85, 0.97)
    coverage_80_range: tuple[float, float] = (0.72, 0.93)
    max_blind_regret: float = 0.05
    min_risk_recall: float = 0.50
    max_prob_false_alarm_rate: float = 0.15
    min_share_lines_at_target: float = 0.90

    def fold_origins(self) -> list[date]:
        """Origins oldest first; the latest leaves a full observed horizon behind it."""
        latest = self.last_week - timedelta(weeks=self.horizon)
        return sorted(latest - timedelta(weeks=k * self.step_weeks) for k in range(self.folds))

    @property
    def n_calibration_folds(self) -> int:
        return max(self.folds - self.holdout_folds, 1)
