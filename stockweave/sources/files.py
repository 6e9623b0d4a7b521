"""File scans and sinks for the raw relations and the published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.operators import validate as V
from stockweave.sources import schemas


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text.

    The checks below match columns by name, drop extra ones and cast, counting what does not cast;
    a schema on the reader would bind columns by position and turn bad values into NULL unseen.
    """
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; a known schema spares the footer inference and also reads an empty table."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; ``decimals`` rounds every double column before writing."""
    if decimals is not None:
        df = df.select(*[F.round(f.name, decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def check_sell_out(raw: DataFrame) -> DataFrame:
    df = V.validate(
        raw, schemas.SELL_OUT, "sell_out", key=["date", "upc", "cedis"], non_null=["date", "upc", "cedis", "sell_out_pzs"]
    )
    V.require_zero(V.count_negative(df, "sell_out_pzs"), "sell_out: negative sell_out_pzs")
    return df


def check_stores(raw: DataFrame) -> DataFrame:
    return V.validate(raw, schemas.STORE_CATALOG, "store_catalog", key=["store_nbr"], non_null=["store_nbr", "cedis"])


def check_catalog(raw: DataFrame) -> DataFrame:
    return V.validate(raw, schemas.UPC_CATALOG, "upc_catalog", non_null=["upc"])


def check_inventory(raw: DataFrame) -> DataFrame:
    return V.validate(raw, schemas.INVENTORY, "inventory", non_null=["date", "prime_item_nbr", "upc", "store_nbr"])
