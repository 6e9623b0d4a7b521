from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockweave.functions.calendar import daily_calendar, weekly_calendar
from stockweave.operators import daily as D
from stockweave.operators import inventory as I
from stockweave.operators import validate as V
from stockweave.operators import weekly as W
from stockweave.sources import adapter, files, schemas, staging
from stockweave.sources.staging import spread
from tests.util import days, frame

SALES = "date date, sell_out_pzs double, upc long, cedis string, final_price double, promo_flag int"


def toy_sales(spark):
    gone = {*days("2024-03-26", 2), *days("2024-04-01", 4)}
    return frame(spark, [(d, 10.0, 1, "X", 20.0, 0) for d in days("2024-03-18", 28) if d not in gone], SALES)


def toy_daily(spark):
    return D.complete_daily_calendar(toy_sales(spark), F.lit(date(2024, 4, 14)))


def test_schema_checks(spark):
    with pytest.raises(V.SchemaError, match="missing columns"):
        V.validate(frame(spark, [(1,)], "store_nbr int"), schemas.STORE_CATALOG, "stores")
    dup = frame(spark, [(1, "A"), (1, "A")], "store_nbr long, cedis string")
    with pytest.raises(V.SchemaError, match="duplicate"):
        V.validate(dup, schemas.STORE_CATALOG, "stores", key=["store_nbr"])
    with pytest.raises(V.SchemaError, match="null:cedis"):
        V.validate(frame(spark, [(1, None)], "store_nbr long, cedis string"), schemas.STORE_CATALOG, "stores", non_null=["cedis"])
    with pytest.raises(V.SchemaError, match="cast:store_nbr"):
        V.validate(frame(spark, [("x1", "A")], "store_nbr string, cedis string"), schemas.STORE_CATALOG, "stores")
    ok = V.validate(frame(spark, [("extra", "A", 7)], "store_name string, cedis string, store_nbr int"), schemas.STORE_CATALOG, "stores")
    assert ok.columns == ["store_nbr", "cedis"] and ok.schema["store_nbr"].dataType.simpleString() == "bigint"


def test_unknown_store_and_negative_sales_are_rejected(spark):
    stores = frame(spark, [(10, "X")], "store_nbr long, cedis string")
    inv = frame(spark, [(date(2026, 4, 1), 5, 1, 11, 1.0)], "date date, prime_item_nbr long, upc long, store_nbr long, on_hand_qty double")
    with pytest.raises(V.SchemaError, match="stores missing"):
        I.load_inventory(inv, stores)
    with pytest.raises(V.SchemaError, match="negative"):
        files.check_sell_out(frame(spark, [(date(2026, 4, 1), -1.0, 1, "X", 1.0, 0)], SALES))


def test_csv_round_trip_rounds_and_ignores_extra_columns(spark, tmp_path):
    df = frame(spark, [(date(2026, 4, 1), 1.23456, 1, "X", None, 0, "z")], SALES + ", extra string")
    files.write_csv(df, str(tmp_path / "s"), decimals=4)
    back = files.check_sell_out(files.read_csv(spark, str(tmp_path / "s"))).collect()
    assert [tuple(r) for r in back] == [(date(2026, 4, 1), 1.2346, 1, "X", None, 0)]


def test_catalog_keeps_the_smallest_item_number(spark):
    cat = frame(spark, [(11, 1, "A", "X"), (10, 1, "B", "Y"), (20, 2, "C", "Z")], "prime_item_nbr long, upc long, abc_class string, xyz_class string")
    assert {(r.upc, r.prime_item_nbr, r.cluster) for r in I.dedupe_catalog(cat).collect()} == {(1, 10, "B-Y"), (2, 20, "C-Z")}


def test_inventory_rollup_clips_and_counts(spark):
    rows = [(date(2026, 4, 1), 1, s, q, "X") for s, q in ((10, 10.0), (11, -5.0), (12, 0.0))]
    stock = frame(spark, rows, "date date, upc long, store_nbr long, on_hand_qty double, cedis string")
    r = I.aggregate_to_cedis(stock).collect()[0]
    assert (r.on_hand, r.on_hand_raw, r.stores_reporting, r.stores_at_or_below_zero, r.stores_negative) == (10.0, 5.0, 3, 2, 1)
    assert r.stockout_store_share == pytest.approx(2 / 3)
    assert I.aggregate_to_cedis(stock, clip_negative=False).collect()[0].on_hand == 5.0


def test_item_numbers_are_summed_before_clipping(spark):
    rows = [(date(2026, 4, 1), i, 1, 10, q) for i, q in ((100, 7.0), (101, -3.0))]
    inv = frame(spark, rows, "date date, prime_item_nbr long, upc long, store_nbr long, on_hand_qty double")
    assert [r.on_hand_qty for r in I.collapse_items(inv).collect()] == [4.0]


def test_daily_grid_keeps_gaps_null(spark):
    rows = toy_daily(spark).orderBy("date").collect()
    assert len(rows) == 28 and sum(r.is_missing for r in rows) == 6
    assert sum(r.sell_out_pzs is None for r in rows) == 6
    assert all(r.promo_flag == 0 and r.final_price == 20.0 for r in rows)
    assert [r.date for r in rows] == days("2024-03-18", 28)


def test_weekly_scaling_and_minimum_days(spark):
    daily = D.flag_outliers(toy_daily(spark), 5.0)
    cal = daily_calendar(spark, date(2024, 3, 18), date(2024, 4, 30))
    catalog = frame(spark, [(1, "A-X", "A", "X", 7, 100, 7)], "upc long, cluster string, abc_class string, xyz_class string, lead_time_days long, moq long, safety_stock_days long")
    w = {r.week_start: r for r in W.build_weekly(daily, weekly_calendar(cal), catalog, date(2024, 3, 18), date(2024, 4, 8)).collect()}
    assert w[date(2024, 3, 18)].y == pytest.approx(70.0)
    assert w[date(2024, 3, 25)].days_observed == 5 and w[date(2024, 3, 25)].y == pytest.approx(70.0)
    assert w[date(2024, 4, 1)].y is None and w[date(2024, 4, 1)].days_observed == 3
    assert w[date(2024, 4, 8)].y == pytest.approx(70.0)
    assert [w[k].series_age_weeks for k in sorted(w)] == [0, 1, 2, 3]


def test_week_grid_starts_at_first_usable_week_and_fills_holes(spark):
    mondays = [date(2024, 1, 1) + timedelta(weeks=i) for i in range(6)]
    schema = "upc long, cedis string, week_start date, days_observed long, price_mean double, promo_share double, n_outliers long, zero_days long, y double, y_capped double"
    rows = [(1, "X", mondays[i], 7, 2.0, 0.5, 1, 0, y, y) for i, y in ((0, None), (1, 5.0), (4, 6.0))]
    got = W.fill_week_grid(frame(spark, rows, schema), mondays[5]).orderBy("week_start").collect()
    assert [r.week_start for r in got] == mondays[1:]
    assert [r.y for r in got] == [5.0, None, None, 6.0, None]
    assert [r.promo_share for r in got] == [0.5, 0.0, 0.0, 0.5, 0.0] and all(r.price_mean == 2.0 for r in got)


def test_outlier_is_capped_in_the_training_copy_only(spark):
    rows = [(d, 5000.0 if i == 70 else 100.0 + i * 5 / 79, 1, "X", 1.0, 0) for i, d in enumerate(days("2024-01-01", 80))]
    grid = D.complete_daily_calendar(frame(spark, rows, SALES), F.lit(days("2024-01-01", 80)[-1]))
    out = {r.date: r for r in D.flag_outliers(grid, 5.0).collect()}
    spike = out[days("2024-01-01", 80)[70]]
    assert spike.outlier_flag == 1 and spike.sell_out_pzs > 4000 and spike.sell_out_capped < 200
    assert sum(r.outlier_flag for r in out.values()) == 1


def test_series_flags(spark):
    weeks = [date(2024, 1, 1) + timedelta(weeks=i) for i in range(30)]
    rows = [(1, "X", w, 0.0 if i >= 26 else 70.0, 0.5) for i, w in enumerate(weeks)] + [(2, "X", w, 70.0, 0.0) for w in weeks[20:]]
    weekly = frame(spark, rows, "upc long, cedis string, week_start date, y double, promo_share double")
    daily = frame(spark, [(u, "X", d, 10.0) for u in (1, 2) for d in (date(2024, 1, 1), date(2024, 1, 4))], "upc long, cedis string, date date, sell_out_pzs double")
    inv = frame(spark, [(date(2024, 7, 1), 1, "X", 9.0)], "date date, upc long, cedis string, on_hand double")
    catalog = frame(spark, [(u, "A-X", "A", "X", 7, 100, 7) for u in (1, 2)], "upc long, cluster string, abc_class string, xyz_class string, lead_time_days long, moq long, safety_stock_days long")
    s = {r.upc: r for r in W.build_series(daily, weekly, inv, catalog, date(2024, 7, 1)).collect()}
    assert s[1].is_discontinued and s[1].is_high_promo and not s[1].is_cold_start and s[1].has_inventory
    assert s[2].is_cold_start and not s[2].is_discontinued and not s[2].has_inventory
    assert s[1].interior_gap_days == 2


INVENTORY = "date date, prime_item_nbr long, upc long, store_nbr long, on_hand_qty double"


def parts_of(df):
    """Rows of each partition that has some."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_stock_of_one_file_is_dealt_by_store_before_it_is_grouped(spark):
    """A file of few megabytes holds millions of stock rows; the task that reads it must not group them all."""
    raw = frame(spark, [(d, 10 * u + i, u, s, 1.5) for d in days("2024-03-18", 5) for u in (1, 2) for i in (0, 1) for s in range(40)], INVENTORY).coalesce(1)
    collapsed = I.collapse_items(raw)
    assert sorted(collapsed.select("upc", "on_hand_qty").distinct().collect()) == [(1, 3.0), (2, 3.0)]
    sizes = parts_of(collapsed)
    assert sum(sizes) == 400 and max(sizes) < 200
    assert V.duplicate_rows(raw, ["date", "upc", "store_nbr"]).first()[0] == 400
    plan = V.duplicate_rows(raw, ["date", "upc", "store_nbr"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [date" in plan


def test_derived_stock_is_written_by_many_tasks(spark):
    shelf = frame(spark, [(u, c, (1 if c == "A" else 14) * 1_000_000_000 + s) for u in (1, 2, 3) for c in "AN" for s in range(30)], "upc long, cedis string, store_nbr long")
    sold = frame(spark, [(d, u, c, 70.0 + u) for d in days("2001-10-01", 9) for u in (1, 2, 3) for c in "AN"], "date date, upc long, cedis string, sell_out_pzs double")
    stock = adapter.inventory(shelf.coalesce(1), sold)
    assert stock.count() == 60 * (2 * 21 + 21 + 18) and stock.distinct().count() == stock.count()
    assert max(parts_of(stock)) < stock.count() / 2


def test_more_rows_are_spread_over_more_partitions(spark):
    df = spark.range(100)
    assert spread(df, "id").rdd.getNumPartitions() == 8
    assert spread(df, "id", rows=20 * staging.ROWS_EACH + 1).rdd.getNumPartitions() == 21
