"""Exponential smoothing with an additive damped trend, fitted per series: the best point of a grid, then Gauss-Newton steps.

The history of one series is a short array (one entry per week), so the whole fit is made of
array expressions per (fold, series) row: no Python worker, no shuffle beyond building the array.
A step folds over the array once and carries, beside level and trend, their sensitivities to the
three parameters; what it sums up gives the next step. A step counts only if it lowers the error.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from itertools import product
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.quantiles import finalize
from stockweave.models.future import FOLD_KEY, with_folds
from stockweave.params import LEVELS, QCOLS, SERIES
from stockweave.sources.staging import spread

MIN_OBS = 10
ALPHAS = (0.05, 0.1, 0.2, 0.4, 0.7)
TREND_RATIOS = (0.02, 0.1, 0.3)
PHIS = (0.8, 0.9, 0.98)
#: Gauss-Newton steps, each tried in full and in part; bounds of alpha and phi (beta lies between its least value and alpha).
STEPS, STEP_SHARES = 3, (1.0, 0.25)
ALPHA_RANGE, LEAST_BETA, PHI_RANGE = (0.001, 0.99), 0.0001, (0.8, 0.98)
GRID = tuple((a, a * b, p) for a, b, p in product(ALPHAS, TREND_RATIOS, PHIS))


def interpolate_gaps(weekly: DataFrame, column: str) -> DataFrame:
    """Adds the previous and next observed value and week of every row (both include the row)."""
    forward = Window.partitionBy(*SERIES).orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*SERIES).orderBy(F.desc("week_start")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col("week_start").alias("w"), F.col(column).alias("v")))
    return weekly.withColumn("_prev", F.last(seen, ignorenulls=True).over(forward)).withColumn(
        "_next", F.last(seen, ignorenulls=True).over(backward)
    )


def interpolated_value(origin: Column) -> Column:
    """Linear between neighbours known at the origin, flat at both ends."""
    prev, nxt = F.col("_prev"), F.when(F.col("_next.w") <= origin, F.col("_next"))
    gap, done = F.datediff(nxt["w"], prev["w"]), F.datediff(F.col("week_start"), prev["w"])
    slope = (nxt["v"] - prev["v"]) / F.nullif(gap, F.lit(0))
    return F.coalesce(prev["v"] + slope * done, prev["v"], nxt["v"])


def _history(weekly: DataFrame, origins: Sequence[date]) -> DataFrame:
    filled = with_folds(interpolate_gaps(weekly.select(*SERIES, "week_start", "y_capped"), "y_capped"), origins)
    filled = filled.withColumn("yi", interpolated_value(F.col("origin")))
    return filled.groupBy(*FOLD_KEY, "origin").agg(
        F.sort_array(F.collect_list(F.struct("week_start", "yi"))).alias("_h"),
        F.coalesce(F.avg("yi"), F.lit(0.0)).alias("mean"),
        F.min("yi").alias("lo"), F.max("yi").alias("hi"), F.count(F.lit(1)).alias("n"),
    ).withColumn("ys", F.col("_h.yi")).drop("_h")


def _start(ys: Column) -> tuple[Column, Column]:
    """Level and trend before the first week, from the first ten."""

    def mean_of(first: int, last: int) -> Column:
        return sum((F.element_at(ys, i) for i in range(first + 1, last + 1)), F.element_at(ys, first)) / F.lit(float(last - first + 1))

    trend0 = (mean_of(6, 10) - mean_of(1, 5)) / F.lit(5.0)
    return mean_of(1, 10) - F.lit(5.5) * trend0, trend0


def _best_of_grid(ys: Column) -> Column:
    """Smallest sum of squared one-step errors over the grid: struct(sse, alpha, beta, phi)."""
    level0, trend0 = _start(ys)
    start = F.struct(F.lit(0.0).alias("sse"), level0.alias("l"), trend0.alias("b"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("p")) for a, b, p in GRID])

    def run(g: Column) -> Column:
        def step(s: Column, y: Column) -> Column:
            base = s["l"] + g["p"] * s["b"]
            err = y - base
            return F.struct((s["sse"] + err * err).alias("sse"), (base + g["a"] * err).alias("l"), (g["p"] * s["b"] + g["b"] * err).alias("b"))

        return F.aggregate(ys, start, step, lambda s: F.struct(s["sse"].alias("sse"), g["a"].alias("alpha"), g["b"].alias("beta"), g["p"].alias("phi")))

    return F.array_min(F.transform(grid, run))


_PARAMETERS = ("alpha", "beta", "phi")
# level and trend, their sensitivities to the parameters, and the sums of a step
_STATE = ("l", "b", "l1", "l2", "l3", "b1", "b2", "b3", "g1", "g2", "g3", "h11", "h12", "h13", "h22", "h23", "h33")


def _with_sensitivities(theta: str) -> str:
    """One fold over ``ys`` from ``l0`` and ``b0`` at the parameters of a struct: struct(sse, alpha, beta, phi, and the final state).

    An SQL text, as all of a step's expressions: it is parsed in a fraction of the time that as many column objects take.
    """
    base, err = "(s.l + s.phi * s.b)", "(y - (s.l + s.phi * s.b))"
    slope = ["(s.l1 + s.phi * s.b1)", "(s.l2 + s.phi * s.b2)", "(s.l3 + s.phi * s.b3 + s.b)"]
    rest = "(1D - s.alpha)"
    state = {
        "l": f"{base} + s.alpha * {err}", "b": f"s.phi * s.b + s.beta * {err}",
        "l1": f"{rest} * {slope[0]} + {err}", "l2": f"{rest} * {slope[1]}", "l3": f"{rest} * {slope[2]}",
        "b1": f"s.phi * s.b1 - s.beta * {slope[0]}", "b2": f"s.phi * s.b2 - s.beta * {slope[1]} + {err}", "b3": f"s.phi * s.b3 + s.b - s.beta * {slope[2]}",
    }
    state |= {f"g{i + 1}": f"s.g{i + 1} + {err} * {slope[i]}" for i in range(3)}
    state |= {f"h{i + 1}{j + 1}": f"s.h{i + 1}{j + 1} + {slope[i]} * {slope[j]}" for i in range(3) for j in range(i, 3)}
    struct = lambda fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    # the parameters travel in the state, so that they are computed once and not at every week
    start = {"sse": "0D", **{c: f"{theta}.{c}" for c in _PARAMETERS}, "l": "l0", "b": "b0", **dict.fromkeys(_STATE[2:], "0D")}
    step = {"sse": f"s.sse + {err} * {err}", **{c: f"s.{c}" for c in _PARAMETERS}, **{c: state[c] for c in _STATE}}
    return f"aggregate(ys, {struct(start)}, (s, y) -> {struct(step)})"


def _moved(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Adds ``to<i>``: parameters a share of a damped Gauss-Newton step away from ``fit``, within their bounds."""

    def then(**columns: str) -> None:
        nonlocal rows
        rows = rows.selectExpr("*", *[f"{expr} as {name}" for name, expr in columns.items()])

    sums = [c for c in _STATE if c[0] in "gh"]
    rows = rows.selectExpr(*keep, "fit", *[f"fit.{c}" for c in (*_PARAMETERS, *sums)])
    then(**{f"a{i}": f"h{i}{i} * 1.01D + 1e-6D * (h11 + h22 + h33)" for i in (1, 2, 3)})
    then(m1="a2 * a3 - h23 * h23", m2="h12 * a3 - h23 * h13", m3="h12 * h23 - a2 * h13", n1="g2 * a3 - h23 * g3", n2="g2 * h23 - a2 * g3", n3="h12 * g3 - g2 * h13")
    then(det="nullif(a1 * m1 - h12 * m2 + h13 * m3, 0D)")
    then(d1="(g1 * m1 - h12 * n1 + h13 * n2) / det", d2="(a1 * n1 - g1 * m2 + h13 * n3) / det", d3="(0D - a1 * n2 - h12 * n3 + g1 * m3) / det")
    then(**{f"alpha{i}": f"least(greatest(coalesce(alpha + {share!r}D * d1, alpha), {ALPHA_RANGE[0]!r}D), {ALPHA_RANGE[1]!r}D)" for i, share in enumerate(STEP_SHARES)})
    moved = {
        f"to{i}": f"named_struct('alpha', alpha{i}, 'beta', least(greatest(coalesce(beta + {share!r}D * d2, beta), {LEAST_BETA!r}D), alpha{i}),"
        f" 'phi', least(greatest(coalesce(phi + {share!r}D * d3, phi), {PHI_RANGE[0]!r}D), {PHI_RANGE[1]!r}D))"
        for i, share in enumerate(STEP_SHARES)
    }
    return rows.selectExpr(*keep, "fit", *[f"if(fit is null, null, {expr}) as {name}" for name, expr in moved.items()])


def fit(weekly: DataFrame, origins: Sequence[date]) -> DataFrame:
    """One row per (fold, series): fitted parameters and state, or NULL ones with the plain mean."""
    enough = (F.col("n") >= MIN_OBS) & (F.col("lo") < F.col("hi"))
    # the fit is the costly part: spread the (fold, series) arrays over all tasks, whatever their size in bytes
    history = spread(_history(weekly, origins), *FOLD_KEY)
    keep = [*FOLD_KEY, "origin", "mean", "n", "ys", "l0", "b0"]
    level0, trend0 = (F.when(enough, x) for x in _start(F.col("ys")))
    rows = history.withColumns({"l0": level0, "b0": trend0}).select(*keep, F.when(enough, _best_of_grid(F.col("ys"))).alias("at"))
    rows = rows.selectExpr(*keep, f"if(at is null, null, {_with_sensitivities('at')}) as fit")
    for _ in range(STEPS):
        rows = _moved(rows, keep)
        tried = ", ".join(_with_sensitivities(f"to{i}") for i in range(len(STEP_SHARES)))
        rows = rows.selectExpr(*keep, f"if(fit is null, null, array_min(array(fit, {tried}))) as fit")
    return rows.select(*FOLD_KEY, "origin", "mean", "n", "fit.sse", "fit.alpha", "fit.beta", "fit.phi", F.col("fit.l").alias("level"), F.col("fit.b").alias("trend"))


def ets_damped(weekly: DataFrame, origins: Sequence[date], horizon: int) -> DataFrame:
    """Forecast path with Gaussian intervals from the state-space variance of each step."""
    fitted = fit(weekly, origins)
    phi = F.col("phi")
    steps = []
    damp = damp_sum = F.lit(0.0)
    spread = F.lit(1.0)
    for h in range(1, horizon + 1):
        damp = phi if h == 1 else damp * phi
        damp_sum = damp_sum + damp
        sd = F.sqrt(F.col("sse") / F.col("n") * spread)
        steps.append(F.struct(F.lit(h).alias("h"), (F.col("level") + damp_sum * F.col("trend")).alias("path"), sd.alias("sd")))
        gain = F.col("alpha") + F.col("beta") * damp_sum
        spread = spread + gain * gain
    rows = fitted.withColumn("s", F.explode(F.array(*steps)))
    cols = []
    for level, name in zip(LEVELS, QCOLS, strict=True):
        z = NormalDist().inv_cdf(level)
        path = F.col("s.path") if name == "q50" else F.col("s.path") + F.lit(z) * F.col("s.sd")
        cols.append(F.coalesce(path, F.col("mean")).alias(name))
    return finalize(
        rows.select(*FOLD_KEY, "origin", "s.h", F.date_add("origin", F.col("s.h") * 7).alias("target_week"), F.lit("ets").alias("model"), *cols)
    )
