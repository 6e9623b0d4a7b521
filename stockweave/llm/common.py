"""Shared pieces of the corpus operators: stage tables, words and their hashes.

A word is a run of bytes without ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.sources.staging import shared_folder

SPACES = b" \t\n\x0b\x0c\r"
#: Entries of a worker's word cache; it is emptied when full, so it bounds memory and never changes a result.
CACHE_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Stages:
    """Stage tables of one call, in a folder of their own below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/stockweave-llm/{label}-{uuid.uuid4().hex[:12]}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written once and read back: lineage ends here, a lost executor re-reads files."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def utf8(column: str) -> F.Column:
    """A text column as UTF-8 bytes, null as empty: spares the tasks a decode and an encode."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter that ``narrowed`` sends to the tasks, and of one of the pieces it is made in.
FILTER_BITS, FILTER_PIECE = 1 << 23, 1 << 16


def filter_piece(rows: pa.Table) -> pa.Table:
    bits = np.zeros(FILTER_PIECE, dtype=np.uint8)
    bits[rows.column("cell").to_numpy() % FILTER_PIECE] = 1
    return pa.table({"piece": rows.column("piece")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def narrowed(texts: DataFrame, column: str, ids: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """The rows of ``texts`` whose id may be among ``ids`` (one column): all that are, and some others by chance.

    ``then`` is applied to their batches in the same Python worker, and gives rows of ``schema``.

    A bit for each hash cell of an id: a megabyte at any size of the input. The more ids there are, the more other rows pass,
    so a join has to follow; it then shuffles few texts where few are wanted, and no more than all otherwise.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    cells = ids.select(cell(F.col(ids.columns[0])).alias("cell")).distinct().withColumn("piece", (F.col("cell") / FILTER_PIECE).cast("int"))
    whole = np.zeros(FILTER_BITS, dtype=bool)
    for r in cells.groupBy("piece").applyInArrow(filter_piece, "piece int, bits binary").collect():
        whole[r["piece"] * FILTER_PIECE : (r["piece"] + 1) * FILTER_PIECE] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)).astype(bool)
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(whole).tobytes())

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column("_cell").to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))).drop_columns(["_cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(some(batches)) if then else some(batches)

    return texts.withColumn("_cell", cell(F.col(column))).mapInArrow(run, schema or texts.schema)


_caches: dict[str, dict] = {}


def cache_of(owner: str) -> dict:
    """What a Python worker keeps for the later tasks of one operator; the caches of other operators are emptied."""
    for name, cache in _caches.items():
        if name != owner:
            cache.clear()
    return _caches.setdefault(owner, {})


def unused(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex}"


#: Hashes below it are as good as random; ``sampled`` compares with a part of it.
HASH_SPAN = 1 << 60


def sampled(rows: DataFrame, key: str, seed: str, most: int, n: int) -> DataFrame:
    """About ``most`` of ``n`` rows, by the hash of a key and the same at any partitioning; all of them if there are no more."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HASH_SPAN)) < HASH_SPAN * most // n)


class WordHashes(dict):
    """Word -> 64-bit hash, computed on first sight."""

    def __init__(self) -> None:
        super().__init__()
        cache_of("words")  # empties what other operators have left in this worker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values so that any slice of them is as good as random."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order; a shorter sequence is one run, no words give none."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        out = out * MIX + hashes[i : i + m]
    return finish(out)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
