"""Declared schemas of the four raw relations."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


SELL_OUT = _schema(
    ("date", T.DateType()),
    ("sell_out_pzs", T.DoubleType()),
    ("upc", T.LongType()),
    ("cedis", T.StringType()),
    ("final_price", T.DoubleType()),
    ("promo_flag", T.IntegerType()),
)

INVENTORY = _schema(
    ("date", T.DateType()),
    ("prime_item_nbr", T.LongType()),
    ("upc", T.LongType()),
    ("store_nbr", T.LongType()),
    ("on_hand_qty", T.DoubleType()),
)

STORE_CATALOG = _schema(("store_nbr", T.LongType()), ("cedis", T.StringType()))

UPC_CATALOG = _schema(
    ("prime_item_nbr", T.LongType()),
    ("upc", T.LongType()),
    ("avg_daily_sales", T.DoubleType()),
    ("median_daily_sales", T.DoubleType()),
    ("std_daily_sales", T.DoubleType()),
    ("cv_demand", T.DoubleType()),
    ("sales_share", T.DoubleType()),
    ("abc_class", T.StringType()),
    ("xyz_class", T.StringType()),
    ("lead_time_days", T.LongType()),
    ("moq", T.LongType()),
    ("safety_stock_days", T.LongType()),
)
