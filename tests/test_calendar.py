from datetime import date

from pyspark.sql import functions as F

from stockweave.functions import calendar as cal
from tests.util import frame


def test_moving_feasts(spark):
    years = frame(spark, [(2024,), (2025,), (2000,)], "y int")
    got = {r.y: (r.monday, r.easter) for r in years.select("y", cal.nth_monday(F.col("y"), 11, 3).alias("monday"), cal.easter_sunday(F.col("y")).alias("easter")).collect()}
    assert got[2024] == (date(2024, 11, 18), date(2024, 3, 31))
    assert got[2025][1] == date(2025, 4, 20)
    assert got[2000][1] == date(2000, 4, 23)


def test_buen_fin_2024_is_four_days(spark):
    rows = cal.daily_calendar(spark, date(2024, 11, 1), date(2024, 11, 30)).filter("is_buen_fin = 1").select("date").collect()
    assert sorted(r.date for r in rows) == [date(2024, 11, d) for d in (15, 16, 17, 18)]


def test_semana_santa_2025(spark):
    rows = cal.daily_calendar(spark, date(2025, 4, 1), date(2025, 4, 30)).filter("is_semana_santa = 1").select("date").collect()
    assert sorted(r.date for r in rows) == [date(2025, 4, d) for d in range(13, 21)]


def test_paydays_holidays_and_week_start(spark):
    c = {r.date: r for r in cal.daily_calendar(spark, date(2025, 2, 1), date(2025, 3, 3)).collect()}
    assert c[date(2025, 2, 15)].is_payday == 1 and c[date(2025, 2, 28)].is_payday == 1 and c[date(2025, 2, 20)].is_payday == 0
    assert c[date(2025, 2, 17)].is_payday_window == 1 and c[date(2025, 2, 18)].is_payday_window == 0
    assert c[date(2025, 3, 2)].is_payday_window == 1
    # 31 January is before the first calendar day, so 1 February does not inherit it
    assert c[date(2025, 2, 1)].is_payday_window == 0
    assert c[date(2025, 2, 3)].is_holiday == 1 and c[date(2025, 2, 17)].is_holiday == 0
    assert c[date(2025, 2, 10)].week_start == date(2025, 2, 10) and c[date(2025, 2, 16)].week_start == date(2025, 2, 10)
    assert c[date(2025, 2, 16)].dow == 6 and c[date(2025, 2, 16)].is_weekend == 1


def test_handover_days(spark):
    rows = cal.daily_calendar(spark, date(2018, 1, 1), date(2024, 12, 31)).filter("is_holiday = 1").select("date").collect()
    seen = {r.date for r in rows}
    assert date(2018, 12, 1) in seen and date(2024, 10, 1) in seen and date(2024, 12, 1) not in seen


def test_weekly_calendar_counts_days(spark):
    daily = cal.daily_calendar(spark, date(2024, 12, 9), date(2024, 12, 22))
    weeks = {r.week_start: r for r in cal.weekly_calendar(daily).collect()}
    assert weeks[date(2024, 12, 9)].december_peak_days == 1 and weeks[date(2024, 12, 16)].december_peak_days == 7
    assert weeks[date(2024, 12, 16)].week_of_year == 51 and weeks[date(2024, 12, 16)].month == 12
