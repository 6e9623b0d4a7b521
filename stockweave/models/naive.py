"""Moving average and seasonal naive with intervals from their own in-sample errors.

Window columns are computed once per series; folds are attached afterwards, so eight origins
cost one pass over the history and a single exchange on the series key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.quantiles import finalize
from stockweave.models.future import FOLD_KEY, with_folds
from stockweave.params import LEVELS, QCOLS, SERIES

MIN_RESIDUALS = 8
SEASON_WEEKS = 52


def interval(point: Column, resid_quantiles: Column, n_resid: Column) -> list[Column]:
    """Quantile columns: point plus residual quantile, a fixed band when residuals are few, median = point."""
    out = []
    for i, (level, name) in enumerate(zip(LEVELS, QCOLS, strict=True)):
        if name == "q50":
            out.append(point.alias(name))
        else:
            banded = point * (1 + (level - 0.5))
            out.append(F.when(n_resid >= MIN_RESIDUALS, point + F.element_at(resid_quantiles, i + 1)).otherwise(banded).alias(name))
    return out


def residual_columns(weekly: DataFrame, window: int, horizon: int) -> DataFrame:
    """Per week and step: actual minus the moving average that was known ``h`` weeks earlier."""
    by_week = Window.partitionBy(*SERIES).orderBy("week_start")
    return weekly.select(
        *SERIES, "week_start", "y",
        *[(F.col("y") - F.avg("y").over(by_week.rowsBetween(-(h + window - 1), -h))).alias(f"r{h}") for h in range(1, horizon + 1)],
    )


def _level_array() -> str:
    return "array(" + ", ".join(f"{q}D" for q in LEVELS) + ")"


def moving_average(weekly: DataFrame, origins: Sequence[date], horizon: int, window: int = 4) -> DataFrame:
    """Mean of the last ``window`` observed weeks at each origin, flat over the horizon."""
    by_week = Window.partitionBy(*SERIES).orderBy("week_start")
    by_seen = Window.partitionBy(*SERIES).orderBy("_seen").rangeBetween(-(window - 1), 0)
    columns = (
        residual_columns(weekly, window, horizon)
        .withColumn("_seen", F.count("y").over(by_week.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_mean", F.avg("y").over(by_seen))
    )
    per_fold = with_folds(columns, origins).groupBy(*FOLD_KEY, "origin").agg(
        F.coalesce(F.max_by("_mean", "week_start"), F.lit(0.0)).alias("point"),
        *[F.expr(f"percentile(r{h}, {_level_array()})").alias(f"p{h}") for h in range(1, horizon + 1)],
        *[F.count(f"r{h}").alias(f"n{h}") for h in range(1, horizon + 1)],
    )
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.col("point"), F.col(f"p{h}").alias("p"), F.col(f"n{h}").alias("n")) for h in range(1, horizon + 1)])
    return _emit(per_fold.select(*FOLD_KEY, "origin", F.explode(steps).alias("s")), f"ma{window}")


def seasonal_naive(weekly: DataFrame, origins: Sequence[date], horizon: int) -> DataFrame:
    """Same week last year, else the last observed week; one residual set for every step."""
    by_week = Window.partitionBy(*SERIES).orderBy("week_start")
    columns = weekly.select(*SERIES, "week_start", "y", (F.col("y") - F.lag("y", SEASON_WEEKS).over(by_week)).alias("r"))
    year_ago = [F.max(F.when(F.col("week_start") == F.date_add("origin", 7 * h - 7 * SEASON_WEEKS), F.col("y"))).alias(f"y{h}") for h in range(1, horizon + 1)]
    per_fold = with_folds(columns, origins).groupBy(*FOLD_KEY, "origin").agg(
        F.coalesce(F.max_by("y", F.when(F.col("y").isNotNull(), F.col("week_start"))), F.lit(0.0)).alias("last_y"),
        F.expr(f"percentile(r, {_level_array()})").alias("p"),
        F.count("r").alias("n"),
        *year_ago,
    )
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.coalesce(f"y{h}", "last_y").alias("point"), F.col("p"), F.col("n")) for h in range(1, horizon + 1)])
    return _emit(per_fold.select(*FOLD_KEY, "origin", F.explode(steps).alias("s")), "seasonal_naive")


def _emit(steps: DataFrame, model: str) -> DataFrame:
    rows = steps.select(
        *FOLD_KEY, "origin", "s.h", F.date_add("origin", F.col("s.h") * 7).alias("target_week"), F.lit(model).alias("model"),
        *interval(F.col("s.point"), F.col("s.p"), F.col("s.n")),
    )
    return finalize(rows)
