"""Stage tables: a result written once to the shared checkpoint folder and read back.

A written table cuts the lineage (a lost executor re-reads files instead of replaying the
plan), keeps column pruning and filter pushdown for the readers, and is what the stages hand
to each other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session may get its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


class StageStore:
    """Named stage tables of one run. ``table`` builds a stage on first use and reads it afterwards."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/stockweave/{label}-{uuid.uuid4().hex[:12]}"
        self._schemas: dict[str, object] = {}
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        with self._locks[name]:
            if name not in self._schemas:
                df = build()
                df.write.mode("overwrite").parquet(path)
                self._schemas[name] = df.schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)


#: Rows of one partition that ``spread`` aims at when it knows their number; a hash table over so many takes some 100 MB.
ROWS_EACH = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash partitions on ``keys`` in the session's full shuffle width, more for very many ``rows``, for work that is heavy per row.

    A grouping on these keys (and others) follows without an exchange, so no task that reads a file groups all rows of it:
    a file of a few megabytes may hold tens of millions.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, -(-rows // ROWS_EACH)), *keys)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """File count, bytes and latest change of the inputs: listing only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()
    return tuple(str(v) for v in row)
