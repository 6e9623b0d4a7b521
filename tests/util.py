from datetime import date, timedelta

from pyspark.sql import SparkSession


def days(start: str, n: int) -> list[date]:
    first = date.fromisoformat(start)
    return [first + timedelta(days=i) for i in range(n)]


def frame(spark: SparkSession, rows: list, schema: str):
    return spark.createDataFrame(rows, schema)
