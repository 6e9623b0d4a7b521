"""The four raw relations derived from the star-schema tables.

Everything is fixed arithmetic on the tables, so another engine can reproduce it. Sales come
from ``lineitem``; stores are the suppliers, one store per supplier and distribution centre,
so the inventory grows with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.params import SERIES
from stockweave.sources.staging import spread

INVENTORY_START, INVENTORY_END = date(2001, 10, 15), date(2001, 11, 4)


@dataclass(frozen=True)
class RawRelations:
    sell_out: DataFrame
    stores: DataFrame
    catalog: DataFrame
    inventory: DataFrame


def _dc_number(cedis: Column) -> Column:
    """Small integer per distribution centre: A = 1 .. Z = 26."""
    return (F.ascii(cedis) - 64).cast("long")


def sales_lines(spark: SparkSession, sf_dir: str, grain: str = "type_flag") -> DataFrame:
    """Order lines with product, distribution centre and store.

    ``type_flag``: product type x return flag (18 series). ``flag_all``: return flag x one
    centre (3 dense series for tiny data). ``brand_region``: brand x region (125 series).
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.to_date("l_shipdate").alias("date"),
    )
    if grain == "flag_all":
        keyed = lines.select("*", _dc_number(F.col("l_returnflag")).alias("upc"), F.lit("ALL").alias("cedis"))
    elif grain == "type_flag":
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
        # p_type is a short code list, so its sorted names fit one row
        names = part.agg(F.sort_array(F.collect_set("p_type"))).scalar()
        part = part.select(F.col("p_partkey").alias("l_partkey"), F.array_position(names, F.col("p_type")).alias("upc"))
        keyed = lines.join(part, "l_partkey").withColumn("cedis", F.col("l_returnflag"))
    elif grain == "brand_region":
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
            F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("upc")
        )
        supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("cedis"))
        # nation and region are fixed lists of 25 and 5 rows; part and supplier grow, so their join is left to the planner
        places = supplier.join(F.broadcast(nation.join(F.broadcast(region), "n_regionkey")), "s_nationkey")
        keyed = lines.join(part, "l_partkey").join(places.select("l_suppkey", "cedis"), "l_suppkey")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return keyed.select(
        "date", "upc", "cedis", (_dc_number(F.col("cedis")) * 1_000_000_000 + F.col("l_suppkey")).alias("store_nbr"), "l_quantity", "amount"
    )


def sell_out(lines: DataFrame) -> DataFrame:
    """Daily units, mean unit price and promotion flag; a promotion runs one week in eight per product."""
    daily = lines.groupBy("date", *SERIES).agg(F.sum("l_quantity").alias("sell_out_pzs"), F.sum("amount").alias("amount"))
    return daily.select(
        "date", "sell_out_pzs", *SERIES,
        (F.col("amount").cast("double") / F.col("sell_out_pzs")).alias("final_price"),
        (F.weekofyear("date") % 8 == F.col("upc") % 8).cast("int").alias("promo_flag"),
    )


def shelf(lines: DataFrame) -> DataFrame:
    """Every product a store has sold; the distinct runs map-side first, so hot keys shrink before the shuffle."""
    return lines.select(*SERIES, "store_nbr").distinct()


def stores(shelf: DataFrame) -> DataFrame:
    return shelf.select("store_nbr", "cedis").distinct()


def inventory(shelf: DataFrame, sold: DataFrame) -> DataFrame:
    """Store stock for 21 days around the as-of date for every product a store has sold.

    The level follows the series' mean daily sales; negative and empty stores, a chronic
    shortage, a shortage that starts inside the window, recurring dips and a partial last
    week are planted.
    """
    width = shelf.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_stores"))
    level = (
        sold.groupBy(*SERIES).agg(F.avg("sell_out_pzs").alias("mean_daily")).join(width, list(SERIES))
        .select(*SERIES, (F.ceil(F.col("mean_daily") * 50 / F.col("n_stores")) / 100.0 * (1 + F.col("upc") % 3)).alias("k"))
    )
    supplier = F.col("store_nbr") % 1_000_000_000
    day = F.unix_date("date").cast("long")
    pattern = (supplier * 31 + F.col("upc") * 17 + day * 7) % 41 - 4
    dip = (F.col("upc") % 2 == 0) & ((F.col("upc") * 5 + _dc_number(F.col("cedis")) + day) % 23 < 4)
    chronic = (F.col("upc") == 2) & (F.col("cedis") == "A") & (supplier % 2 == 0)
    onset = (F.col("upc") == 3) & (F.col("cedis") == "R") & (supplier % 10 < 4) & (F.col("date") >= F.lit(date(2001, 10, 23)))
    # a row becomes one or two for each of 21 days
    stocked = (
        spread(shelf.join(level, list(SERIES)), "store_nbr", rows=40 * shelf.count())
        .withColumn("date", F.explode(F.sequence(F.lit(INVENTORY_START), F.lit(INVENTORY_END))))
        .filter((F.col("date") <= F.lit(date(2001, 11, 1))) | (F.col("upc") <= 2))
        .withColumn(
            "on_hand_qty",
            F.when(chronic | onset | (dip & (supplier % 3 == 0)), F.lit(0.0)).otherwise(pattern * F.col("k") * F.when(dip, F.lit(0.25)).otherwise(F.lit(1.0))),
        )
    )
    # product 1 is stocked under two item numbers
    items = F.when(F.col("upc") == 1, F.array(F.col("upc") * 10, F.col("upc") * 10 + 1)).otherwise(F.array(F.col("upc") * 10))
    return stocked.select("date", F.explode(items).alias("prime_item_nbr"), "upc", "store_nbr", "on_hand_qty")


def catalog(sold: DataFrame) -> DataFrame:
    """Product statistics and classes: ABC by the share against an equal split, XYZ by arithmetic."""
    per_upc = sold.groupBy("upc").agg(
        F.avg("sell_out_pzs").alias("avg_daily_sales"),
        F.expr("percentile(sell_out_pzs, 0.5)").alias("median_daily_sales"),
        F.stddev_samp("sell_out_pzs").alias("std_daily_sales"),
        F.sum("sell_out_pzs").alias("units"),
    )
    total = sold.agg(F.sum("sell_out_pzs")).scalar()
    n_products = sold.agg(F.count_distinct("upc")).scalar()
    abc = F.when(F.col("sales_share") * n_products >= 1.0, "A").when(F.col("sales_share") * n_products >= 0.95, "B").otherwise("C")
    xyz = F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("upc") % 3 + 1).cast("int"))
    classed = per_upc.withColumn("sales_share", F.col("units") / total).select("*", abc.alias("abc_class"), xyz.alias("xyz_class"))
    items = F.when(F.col("upc") == 1, F.array(F.col("upc") * 10, F.col("upc") * 10 + 1)).otherwise(F.array(F.col("upc") * 10))
    return classed.select(
        F.explode(items).alias("prime_item_nbr"), "upc", "avg_daily_sales", "median_daily_sales", "std_daily_sales",
        (F.col("std_daily_sales") / F.col("avg_daily_sales")).alias("cv_demand"), "sales_share", "abc_class", "xyz_class",
        F.lit(7).cast("long").alias("lead_time_days"),
        F.when(F.col("upc") == 2, 50).otherwise(100).cast("long").alias("moq"),
        F.when(F.col("abc_class") == "C", 14).otherwise(7).cast("long").alias("safety_stock_days"),
    )


def raw_relations(spark: SparkSession, sf_dir: str, grain: str = "type_flag") -> RawRelations:
    lines = sales_lines(spark, sf_dir, grain)
    sold, on_shelf = sell_out(lines), shelf(lines)
    return RawRelations(sold, stores(on_shelf), catalog(sold), inventory(on_shelf, sold))
