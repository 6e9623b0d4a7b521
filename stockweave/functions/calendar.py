"""Calendar effects as pure date expressions, and the daily and weekly calendar tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The known-in-advance daily flags.
FLAGS = ("is_payday", "is_payday_window", "is_holiday", "is_semana_santa", "is_buen_fin", "is_december_peak")


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.trunc(day, "week")


def _on(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def nth_monday(year: Column, month: int, n: int) -> Column:
    first = _on(year, month, 1)
    return F.date_add(first, (7 - F.weekday(first)) % 7 + 7 * (n - 1))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the Meeus/Jones/Butcher rule, in integer column arithmetic."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden, century, yy = year % 19, div(year, 100), year % 100
    skipped = div(century, 4)
    correction = div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - skipped - correction + 15) % 30
    weekday = (32 + (century % 4) * 2 + div(yy, 4) * 2 - epact - yy % 4) % 7
    late = div(golden + epact * 11 + weekday * 22, 451)
    march_days = epact + weekday - late * 7 + 114
    return F.make_date(year, div(march_days, 31), march_days % 31 + 1)


def is_semana_santa(day: Column) -> Column:
    """Palm Sunday to Easter Sunday."""
    easter = easter_sunday(F.year(day))
    return day.between(F.date_sub(easter, 7), easter)


def is_buen_fin(day: Column) -> Column:
    """Friday to Monday ending on the third Monday of November."""
    monday = nth_monday(F.year(day), 11, 3)
    return day.between(F.date_sub(monday, 3), monday)


def is_payday(day: Column) -> Column:
    return (F.dayofmonth(day) == 15) | (day == F.last_day(day))


def is_public_holiday(day: Column) -> Column:
    """Mexican statutory holidays.

    The February and March holidays moved to Mondays in 2007 and the November one in 2006; the
    federal handover falls every six years, on 1 December until 2018 and 1 October from 2024.
    """
    year = F.year(day)
    handover = ((year - 1970) % 6 == 0) & (year >= 1970)
    return (
        (day == _on(year, 1, 1))
        | (day == F.when(year <= 2006, _on(year, 2, 5)).otherwise(nth_monday(year, 2, 1)))
        | (day == F.when(year <= 2006, _on(year, 3, 21)).otherwise(nth_monday(year, 3, 3)))
        | (day == _on(year, 5, 1))
        | (day == _on(year, 9, 16))
        | (day == F.when(year <= 2005, _on(year, 11, 20)).otherwise(nth_monday(year, 11, 3)))
        | (day == _on(year, 12, 25))
        | (handover & (day == F.when(year >= 2024, _on(year, 10, 1)).otherwise(_on(year, 12, 1))))
    )


def daily_calendar(spark: SparkSession, start: date, end: date | Column) -> DataFrame:
    """One row per day in [start, end]; ``end`` may be a column, such as a scalar subquery."""
    first = F.lit(start)
    last = end if isinstance(end, Column) else F.lit(end)
    day = F.col("date")
    # payday and the two days after it, never looking before the first calendar day
    window = is_payday(day)
    for back in (1, 2):
        window = window | (is_payday(F.date_sub(day, back)) & (F.date_sub(day, back) >= first))
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("date")).select(
        "date",
        F.weekday(day).alias("dow"),
        (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
        is_payday(day).cast("int").alias("is_payday"),
        window.cast("int").alias("is_payday_window"),
        is_public_holiday(day).cast("int").alias("is_holiday"),
        is_semana_santa(day).cast("int").alias("is_semana_santa"),
        is_buen_fin(day).cast("int").alias("is_buen_fin"),
        ((F.month(day) == 12) & (F.dayofmonth(day) >= 15)).cast("int").alias("is_december_peak"),
        week_start(day).alias("week_start"),
    )


def weekly_calendar(daily: DataFrame) -> DataFrame:
    """Days per week carrying each flag, with ISO week and month of the Monday."""
    return daily.groupBy("week_start").agg(*[F.sum(c).alias(c.removeprefix("is_") + "_days") for c in FLAGS]).select(
        "*", F.weekofyear("week_start").alias("week_of_year"), F.month("week_start").alias("month")
    )
