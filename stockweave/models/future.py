"""What every forecaster shares: fold origins, training slices and the future grid."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.params import SERIES

FOLD_KEY = ("fold", *SERIES)


def _fold_array(origins: Sequence[date]):
    return F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(o).alias("origin")) for i, o in enumerate(origins)])


def with_folds(weekly: DataFrame, origins: Sequence[date], after_weeks: int = 0) -> DataFrame:
    """Every week once per fold whose origin it precedes (or follows by at most ``after_weeks``).

    The handful of origins is a literal, so this is an explode with a filter and no join.
    """
    spread = weekly.withColumn("_f", F.explode(_fold_array(origins))).select("*", "_f.fold", "_f.origin").drop("_f")
    return spread.filter(F.col("week_start") <= F.date_add("origin", 7 * after_weeks))


def eligible_series(train: DataFrame, min_weeks: int) -> DataFrame:
    """(fold, series) with at least ``min_weeks`` observed weeks at the origin."""
    return train.groupBy(*FOLD_KEY).agg(F.count("y").alias("n_weeks_at_origin")).filter(F.col("n_weeks_at_origin") >= min_weeks)


def make_future(train: DataFrame, horizon: int, weekly_cal: DataFrame) -> DataFrame:
    """(fold, series) x horizon grid with the calendar of each target week."""
    grid = (
        train.select(*FOLD_KEY, "origin").distinct()
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("target_week", F.date_add("origin", F.col("h") * 7))
    )
    return grid.join(F.broadcast(weekly_cal.withColumnRenamed("week_start", "target_week")), "target_week", "left")
