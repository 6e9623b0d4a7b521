"""Store stock rolled up to distribution centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.operators import validate as V
from stockweave.sources.staging import spread


def dedupe_catalog(catalog: DataFrame) -> DataFrame:
    """One row per product (smallest item number) with its ABC-XYZ cluster."""
    rest = [c for c in catalog.columns if c != "upc"]
    first = catalog.groupBy("upc").agg(F.min(F.struct("prime_item_nbr", *[c for c in rest if c != "prime_item_nbr"])).alias("r"))
    return first.select("upc", *[F.col(f"r.{c}").alias(c) for c in rest]).withColumn(
        "cluster", F.concat_ws("-", "abc_class", "xyz_class")
    )


def collapse_items(inventory: DataFrame) -> DataFrame:
    """Stock per day, product and store, summed over item numbers; few rows share a group, so they are dealt by store before."""
    return spread(inventory, "store_nbr", rows=inventory.count()).groupBy("date", "upc", "store_nbr").agg(F.coalesce(F.sum("on_hand_qty"), F.lit(0.0)).alias("on_hand_qty"))


def attach_centre(stock: DataFrame, stores: DataFrame) -> DataFrame:
    return stock.join(stores, "store_nbr", "left")


def load_inventory(inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Collapsed stock with its distribution centre; stores must be known."""
    V.require_no_rows(V.unmatched_keys(inventory, stores, "store_nbr"), "inventory: stores missing from the store catalog")
    return attach_centre(collapse_items(inventory), stores)


def aggregate_to_cedis(stock: DataFrame, clip_negative: bool = True) -> DataFrame:
    """Stock per day, product and centre with the stores that report at or below zero; a store has one row per day and product."""
    qty = F.col("on_hand_qty")
    rolled = stock.groupBy("date", "upc", "cedis").agg(
        F.sum(F.greatest(qty, F.lit(0.0)) if clip_negative else qty).alias("on_hand"),
        F.sum(qty).alias("on_hand_raw"),
        F.count("store_nbr").alias("stores_reporting"),
        F.count_if(qty <= 0).alias("stores_at_or_below_zero"),
        F.count_if(qty < 0).alias("stores_negative"),
    )
    return rolled.withColumn("stockout_store_share", F.col("stores_at_or_below_zero") / F.col("stores_reporting"))


def coverage_by_date(stock: DataFrame) -> DataFrame:
    return stock.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("upc").alias("upcs"), F.count_distinct("store_nbr").alias("stores")
    )
