"""Forecast and alert metrics as aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.quantiles import grouped_quantiles, join_groups
from stockweave.params import LEVELS, QCOLS, SERIES


def _over(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def wape(y: Column, yhat: Column) -> Column:
    return _over(F.sum(F.abs(y - yhat)), F.sum(F.abs(y)))


def mape(y: Column, yhat: Column) -> Column:
    return F.avg(F.when(y > 0, F.abs(y - yhat) / F.nullif(y, F.lit(0.0))))


def bias(y: Column, yhat: Column) -> Column:
    return _over(F.sum(yhat - y), F.sum(F.abs(y)))


def pinball(y: Column, yhat: Column, level: float) -> Column:
    diff = y - yhat
    return F.avg(F.greatest(F.lit(level) * diff, F.lit(level - 1) * diff))


def scaled_pinball(y: Column, yhat: Column, level: float) -> Column:
    return _over(pinball(y, yhat, level), F.avg(F.abs(y)))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(y.between(lo, hi).cast("int"))


def weighted_mean(value: str, weight: str = "n") -> Column:
    return _over(F.sum(F.col(value) * F.col(weight)), F.sum(F.col(weight).cast("double")))


def summarize_forecasts(pred: DataFrame, keys: Sequence[str], y: str = "y", point: str = "q50") -> DataFrame:
    """n, WAPE, MAPE, bias, scaled pinball, coverage and median relative width per group."""
    actual, yhat = F.col(y), F.col(point)
    rows = pred.filter(actual.isNotNull() & yhat.isNotNull()).select(
        *keys, *dict.fromkeys([y, point, *QCOLS]), ((F.col("q95") - F.col("q05")) / F.greatest(yhat, F.lit(1e-9))).alias("width")
    )
    losses = [scaled_pinball(actual, F.col(q), level) for q, level in zip(QCOLS, LEVELS, strict=True)]
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        wape(actual, yhat).alias("wape"),
        mape(actual, yhat).alias("mape"),
        bias(actual, yhat).alias("bias"),
        (sum(losses[1:], losses[0]) / len(losses)).alias("pinball"),
        coverage(actual, F.col("q05"), F.col("q95")).alias("coverage_90"),
        coverage(actual, F.col("q10"), F.col("q90")).alias("coverage_80"),
    )
    return join_groups(means, grouped_quantiles(rows, keys, {"width_rel": ("width", 0.5)}), keys)


def expand_levels(df: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Every row once per grouping level, keys outside the level set to NULL (grouping sets)."""
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    types = dict(df.dtypes)
    variants = F.array(*[
        F.struct(F.lit(name).alias("level"), *[(F.col(k) if k in cols else F.lit(None).cast(types[k])).alias(k) for k in keys])
        for name, cols in levels.items()
    ])
    return df.select(*[c for c in df.columns if c not in keys], F.explode(variants).alias("_lv")).select("*", "_lv.*").drop("_lv")


def summarize_levels(pred: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """``summarize_forecasts`` for several groupings in one pass; column ``level`` names the grouping."""
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    return summarize_forecasts(expand_levels(pred.select("y", *QCOLS, *keys), levels), ["level", *keys])


def alert_metrics(alert: Column, event: Column) -> list[Column]:
    """Confusion-based aggregates; ratios are NULL on a zero denominator."""
    alerts, events = F.count_if(alert), F.count_if(event)
    hits, false_alarms = F.count_if(alert & event), F.count_if(alert & ~event)
    precision, recall = F.try_divide(hits, alerts), F.try_divide(hits, events)
    return [
        F.count(F.lit(1)).alias("n"),
        alerts.alias("n_alerts"),
        events.alias("n_events"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(F.lit(2.0) * precision * recall, precision + recall).alias("f1"),
        F.try_divide(false_alarms, F.count_if(~event)).alias("false_alarm_rate"),
    ]


def lead_time_to_alert(alerts: DataFrame, events: DataFrame, max_lead: int) -> DataFrame:
    """Per event: days from the earliest alert in the ``max_lead`` days before it, else NULL.

    Alerts and events share one range window per series, so no alert-event pairs are formed.
    """
    day = F.unix_date("date")
    both = alerts.select(*SERIES, "date", F.lit(False).alias("_is_event")).unionByName(
        events.select(*SERIES, "date", F.lit(True).alias("_is_event"))
    )
    before = Window.partitionBy(*SERIES).orderBy(day).rangeBetween(-max_lead, -1)
    first_alert = F.min(F.when(~F.col("_is_event"), day)).over(before)
    return both.withColumn("lead_time_days", (day - first_alert).cast("int")).filter("_is_event").drop("_is_event")
