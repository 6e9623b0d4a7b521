"""Quality gates: one aggregate per source relation, spread into one row per gate and scored together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.calendar import week_start
from stockweave.functions.metrics import weighted_mean
from stockweave.operators.validate import duplicate_rows
from stockweave.params import QCOLS, SERIES, Params

NAIVE = ("ma4", "seasonal_naive")
KEY_ORDER_COLUMNS = ("order_qty", "implied_service_level", "working_capital", "demand_p50", "on_hand_projected", "unit_value")


class GateError(RuntimeError):
    """At least one hard gate failed."""


def gate(area: str, name: str, value: Column, op: str, threshold: float | tuple[float, float] | Column, severity: str, note: str | Column = "") -> Column:
    """One gate as a struct; a range threshold goes with op ``in``, a column threshold is read from the same row."""
    if isinstance(threshold, tuple):
        lo, hi = (F.lit(float(x)) for x in threshold)
        text = F.lit(f"[{threshold[0]}, {threshold[1]}]")
    elif isinstance(threshold, Column):
        lo = hi = threshold.cast("double")
        text = lo.cast("string")
    else:
        lo = hi = F.lit(float(threshold))
        text = F.lit(str(threshold))
    note_col = note if isinstance(note, Column) else F.lit(note)
    return F.struct(
        F.lit(area).alias("area"), F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(op).alias("op"),
        text.alias("threshold"), F.lit(severity).alias("severity"), note_col.alias("note"), lo.alias("lo"), hi.alias("hi"),
    )


def gate_rows(one_row: DataFrame, gates: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def scorecard(gates: DataFrame) -> DataFrame:
    """Adds the status: a missing or NaN value never passes; a failed hard gate is FAIL, a soft one warn."""
    v, op = F.col("value"), F.col("op")
    ok = (
        F.when(op == "<=", v <= F.col("hi")).when(op == ">=", v >= F.col("lo"))
        .when(op == "==", F.abs(v - F.col("lo")) < 1e-9).when(op == "in", v.between(F.col("lo"), F.col("hi")))
    )
    passed = F.coalesce(ok & ~F.isnan(v), F.lit(False))
    status = F.when(passed, "pass").when(F.col("severity") == "hard", "FAIL").otherwise("warn")
    return gates.withColumn("status", status).drop("lo", "hi")


def status_counts(card: DataFrame) -> DataFrame:
    return card.groupBy("status").agg(F.count(F.lit(1)).alias("n_gates"))


def require_pass(card: DataFrame) -> None:
    """Raise on failed hard gates; call it after the scorecard is written."""
    failed = [r.gate for r in card.filter("status = 'FAIL'").select("gate").orderBy("gate").collect()]
    if failed:
        raise GateError(f"{len(failed)} hard gate(s) failed: {failed}")


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


# ------------------------------------------------------------------ gate groups
def data_gates(daily: DataFrame, weekly: DataFrame, series: DataFrame, p: Params) -> DataFrame:
    key = [*SERIES, "week_start"]
    sums = daily.withColumn("week_start", week_start(F.col("date"))).groupBy(*key).agg(
        F.sum("sell_out_pzs").alias("units"), F.count("sell_out_pzs").alias("n_seen")
    )
    full = weekly.select(*key, "y").join(sums.filter("n_seen = 7"), key).agg(
        F.max(F.abs(F.col("y") - F.col("units")) / F.greatest("units", F.lit(1e-9))).alias("rel"), F.count(F.lit(1)).alias("n_full")
    )
    parts = [
        gate_rows(duplicate_rows(weekly, key), [gate("data", "weekly_duplicate_keys", F.col("surplus_rows"), "==", 0, "hard")]),
        gate_rows(full, [gate(
            "data", "weekly_reconciles_to_daily_max_rel_diff", F.col("rel"), "<=", 1e-6, "hard",
            F.format_string("%d fully observed weeks compared", F.col("n_full")),
        )]),
        gate_rows(weekly.agg(_share(F.col("y").isNull()).alias("v")), [
            gate("data", "weekly_y_missing_share", F.col("v"), "<=", p.max_weekly_missing_share, "soft")
        ]),
        gate_rows(series.agg(_share(F.col("has_inventory")).alias("v"), F.count(F.lit(1)).alias("n")), [
            gate("data", "series_with_inventory_share", F.col("v"), ">=", p.min_series_with_inventory_share, "soft"),
            gate("data", "n_series", F.col("n"), ">=", 1, "hard"),
        ]),
    ]
    return _union(parts)


def forecast_gates(
    forecast: DataFrame, series: DataFrame, cluster_metrics: DataFrame, selection: DataFrame, holdout: DataFrame, calibration: DataFrame, p: Params
) -> DataFrame:
    """``holdout`` holds the calibrated metrics by (model, cluster) of the last folds."""
    monotone = F.lit(True)
    for a, b in zip(QCOLS, QCOLS[1:]):
        monotone = monotone & (F.col(b) - F.col(a) >= -1e-9)
    cells = len(QCOLS)

    def cell_share(test) -> Column:
        return sum((F.coalesce(test(F.col(q)), F.lit(False)).cast("int") for q in QCOLS), F.lit(0))

    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    structure = forecast.agg(
        _share(monotone).alias("mono"), (F.avg(cell_share(lambda c: c >= 0)) / cells).alias("nonneg"), (F.avg(cell_share(finite)) / cells).alias("finite")
    )
    per_series = forecast.groupBy(*SERIES).agg(F.count_distinct("h").alias("n_h"), F.count_distinct("model").alias("n_m")).agg(
        _share(F.col("n_h") == p.horizon).alias("full"), _share(F.col("n_m") == 1).alias("one"), F.count(F.lit(1)).alias("n")
    ).withColumn("n_series", series.agg(F.count(F.lit(1))).scalar())

    def selected(metrics: DataFrame) -> DataFrame:
        return metrics.join(selection.select("cluster", F.col("selected_model").alias("model")), ["cluster", "model"])

    accuracy = selected(cluster_metrics).agg(weighted_mean("wape").alias("wape"), weighted_mean("bias").alias("bias")).withColumn(
        "naive",
        cluster_metrics.filter(F.col("model").isin(*NAIVE)).groupBy("model").agg(weighted_mean("wape").alias("w")).agg(F.min("w")).scalar(),
    )
    coverage = selected(holdout).agg(weighted_mean("coverage_90").alias("c90"), weighted_mean("coverage_80").alias("c80"))
    tables = cluster_metrics.agg(F.count_distinct("model").alias("n_models"), F.count_distinct("cluster").alias("n_clusters")).withColumns({
        "n_calib": calibration.agg(F.count(F.lit(1))).scalar(),
        "n_selected": selection.agg(F.count_distinct("cluster")).scalar(),
    })
    parts = [
        gate_rows(structure, [
            gate("forecast", "quantiles_monotone_share", F.col("mono"), "==", 1.0, "hard"),
            gate("forecast", "quantiles_non_negative_share", F.col("nonneg"), "==", 1.0, "hard"),
            gate("forecast", "quantiles_finite_share", F.col("finite"), "==", 1.0, "hard"),
        ]),
        gate_rows(per_series, [
            gate("forecast", "series_with_full_horizon_share", F.col("full"), "==", 1.0, "hard"),
            gate("forecast", "series_covered", F.col("n"), "==", F.col("n_series"), "hard", "no series left without a forecast"),
            gate("forecast", "one_model_per_series_share", F.col("one"), "==", 1.0, "hard"),
        ]),
        gate_rows(accuracy, [
            gate("forecast", "selected_wape_overall", F.col("wape"), "<=", p.max_wape_selected, "hard"),
            gate(
                "forecast", "rel_improvement_vs_best_naive", 1 - F.col("wape") / F.col("naive"), ">=", p.min_rel_improvement_vs_naive, "soft",
                F.when(F.col("naive").isNull(), "no naive baseline").otherwise(F.format_string("best naive WAPE %.3f", F.col("naive"))),
            ),
            gate("forecast", "selected_abs_bias", F.abs("bias"), "<=", p.max_abs_bias, "soft"),
        ]),
        gate_rows(coverage, [
            gate("forecast", "holdout_coverage_90_calibrated", F.col("c90"), "in", p.coverage_90_range, "hard"),
            gate("forecast", "holdout_coverage_80_calibrated", F.col("c80"), "in", p.coverage_80_range, "soft"),
        ]),
        gate_rows(tables, [
            gate("forecast", "calibration_table_complete", F.col("n_calib"), "==", 2 * F.col("n_models") * F.col("n_clusters"), "hard", "each model and cluster needs both intervals"),
            gate("forecast", "selection_covers_all_clusters", F.col("n_selected"), "==", F.col("n_clusters"), "hard"),
        ]),
    ]
    return _union(parts)


def blind_gates(regret: DataFrame, overall: DataFrame, p: Params) -> DataFrame:
    row = regret.agg(weighted_mean("blind_wape_pre_registered").alias("w"), weighted_mean("blind_wape_best").alias("best")).withColumn(
        "naive", overall.filter(F.col("model").isin(*NAIVE)).agg(F.min("wape")).scalar()
    )
    return gate_rows(row, [
        gate("blind", "blind_wape_pre_registered", F.col("w"), "<=", p.max_wape_selected, "hard", "last fold kept out of the choice of models"),
        gate("blind", "blind_selection_regret", F.col("w") - F.col("best"), "<=", p.max_blind_regret, "soft", "cost of choosing before the fold was seen"),
        gate("blind", "blind_beats_best_naive", F.col("naive") - F.col("w"), ">=", 0.0, "soft"),
    ])


def risk_gates(methods: DataFrame, alerts: DataFrame, series: DataFrame, p: Params, n_methods: int = 3) -> DataFrame:
    of_methods = methods.agg(
        F.max("recall").alias("recall"), F.max(F.when(F.col("method") == "prob", F.col("false_alarm_rate"))).alias("far"), F.count(F.lit(1)).alias("n")
    )
    lead = series.select(*SERIES, "lead_time_days")
    high = F.col("severity") == "high"
    justified = (F.col("p_stockout_7d") > 0.75) | (F.col("cover_days") < F.col("lead_time_days"))
    of_alerts = alerts.join(lead, list(SERIES), "left").agg(
        F.count(F.lit(1)).alias("n"), _share(F.col("severity").isin("none", "medium", "high")).alias("valid"),
        _share(F.col("p_stockout_7d").between(0, 1)).alias("unit"),
        F.coalesce(F.avg(F.when(high, F.coalesce(justified, F.lit(False)).cast("int"))), F.lit(1.0)).alias("justified"),
    ).withColumn("n_stocked", series.agg(F.count_if("has_inventory")).scalar())
    return _union([
        gate_rows(of_methods, [
            gate("risk", "best_method_recall", F.col("recall"), ">=", p.min_risk_recall, "soft"),
            gate("risk", "prob_method_false_alarm_rate", F.col("far"), "<=", p.max_prob_false_alarm_rate, "soft"),
            gate("risk", "methods_evaluated", F.col("n"), "==", float(n_methods), "hard"),
        ]),
        gate_rows(of_alerts, [
            gate("risk", "alert_rows_vs_series_with_inventory", F.col("n"), "==", F.col("n_stocked"), "hard"),
            gate("risk", "severity_values_valid_share", F.col("valid"), "==", 1.0, "hard"),
            gate("risk", "p_stockout_in_unit_interval_share", F.col("unit"), "==", 1.0, "hard"),
            gate("risk", "high_severity_implies_prob_or_cover", F.col("justified"), "==", 1.0, "hard"),
        ]),
    ])


def order_gates(orders: DataFrame, series: DataFrame, summary: DataFrame, p: Params) -> DataFrame:
    qty, moq, wc = F.col("order_qty"), F.col("moq"), F.col("working_capital")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in KEY_ORDER_COLUMNS), F.lit(0))
    stopped, clean = F.col("flags").contains("discontinued"), F.col("flags") == ""
    at_target = F.coalesce(F.col("implied_service_level") >= F.col("service_level_target") - 1e-6, F.lit(False)).cast("int")
    lines = orders.agg(
        F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), _share(qty >= 0).alias("nonneg"),
        _share((F.abs(qty % moq) < 1e-6) | (qty == 0)).alias("multiple"),
        F.coalesce(F.avg(F.when(stopped, (qty == 0).cast("int"))), F.lit(1.0)).alias("stopped"),
        _share(F.abs(wc - qty * F.col("unit_value")) <= 1e-3 * F.greatest(F.abs(wc), F.lit(1.0))).alias("wc"),
        _share(F.col("implied_service_level").between(0, 1)).alias("unit"),
        F.coalesce(F.avg(F.when(clean, at_target)), F.lit(1.0)).alias("target"), F.count_if(clean).alias("n_clean"),
    ).withColumns({"n_series": series.agg(F.count(F.lit(1))).scalar(), "dup": duplicate_rows(orders, SERIES).scalar()})
    portfolio = summary.filter("level = 'portfolio'").select(
        (F.col("service_level_weighted") - F.col("ma4_service_level_weighted")).alias("sl"), (F.col("ma4_lines_below_90") - F.col("lines_below_90")).alias("below")
    )
    return _union([
        gate_rows(lines, [
            gate("orders", "one_line_per_series", F.col("n"), "==", F.col("n_series"), "hard"),
            gate("orders", "duplicate_lines", F.col("dup"), "==", 0, "hard"),
            gate("orders", "key_columns_nan_count", F.col("nulls"), "==", 0, "hard"),
            gate("orders", "order_qty_non_negative_share", F.col("nonneg"), "==", 1.0, "hard"),
            gate("orders", "order_qty_moq_multiple_share", F.col("multiple"), "==", 1.0, "hard"),
            gate("orders", "discontinued_orders_zero_share", F.col("stopped"), "==", 1.0, "hard"),
            gate("orders", "working_capital_consistent_share", F.col("wc"), "==", 1.0, "hard"),
            gate("orders", "service_level_in_unit_interval_share", F.col("unit"), "==", 1.0, "hard"),
            gate(
                "orders", "unflagged_lines_at_target_service_level_share", F.col("target"), ">=", p.min_share_lines_at_target, "soft",
                F.format_string("%d unflagged lines", F.col("n_clean")),
            ),
        ]),
        gate_rows(portfolio, [
            gate("orders", "portfolio_service_level_vs_ma4", F.col("sl"), ">=", -1e-9, "soft"),
            gate("orders", "lines_below_90_vs_ma4", F.col("below"), ">=", 0, "soft", "lines at risk, moving average minus model"),
        ]),
    ])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
