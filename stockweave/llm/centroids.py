"""Centroid clustering with Walsh-Hadamard progressive search.

The transform of an integer vector is exact and keeps distances up to the factor of its length. Its first coefficients (few sign
changes) hold the coarse shape, the last ones the detail. The search adds squared differences of coefficients coarse to fine for all
centroids; after each level the distance of the leading centroid is finished, and centroids whose sum so far is strictly above the
smallest finished distance can neither win nor tie and go. Those that are left have all 64 coefficients compared.

Every round reads the vectors once: tasks hold the centroids (k x 64 integers) and give one row of sums for each centroid, so what is
exchanged and what reaches the driver has the size of the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import Stages

DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5
#: Ends of the levels, in coefficients.
LEVELS = (1, 4, 16, 64)
#: Vectors that are searched at once; bounds a task's memory.
BLOCK = 1000
#: Components below this keep all sums of the search within 64 bits; larger ones are computed with Python's integers.
SMALL = 1 << 21


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural-order transform by their number of sign changes."""
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1))


ORDER = sequency_order(DIMENSIONS)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, exact, coefficients coarse to fine."""
    n = x.shape[1]
    half = 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x[:, ORDER]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, from transforms; the smaller number wins a tie.

    Third: coefficients that were compared. Object arrays give exact results for any size of the components.
    """
    n, k = len(vectors), len(centroids)
    total = np.zeros((n, k), dtype=vectors.dtype)
    alive, bound, done, compared = np.ones((n, k), dtype=bool), None, 0, 0
    for level in LEVELS:
        row, col = np.nonzero(alive)
        apart = vectors[row, done:level] - centroids[col, done:level]
        total[row, col] += (apart * apart).sum(axis=1)
        compared += apart.size
        done = level
        if level < DIMENSIONS:
            out = total.max() + 1
            lead = np.where(alive, total, out).argmin(axis=1)
            apart = vectors - centroids[lead]
            finished = (apart * apart).sum(axis=1)
            bound = finished if bound is None else np.minimum(bound, finished)
            alive &= total <= bound[:, None]
    total = np.where(alive, total, total.max() + 1)
    best = total.argmin(axis=1)
    return best, total[np.arange(n), best] // DIMENSIONS, compared


def blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their vectors, the numbers of the nearest centroids and the distances to them, block by block."""
    large = bool(len(centroids)) and max(abs(int(centroids.max())), abs(int(centroids.min()))) >= SMALL
    quick = None if large else transform(centroids.astype(np.int64))
    exact = None
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            x = rows.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            if quick is not None and x.max() < SMALL and x.min() > -SMALL:
                best, distance, _ = nearest(transform(x), quick)
            else:
                exact = transform(centroids.astype(object)) if exact is None else exact
                best, distance, _ = nearest(transform(x.astype(object)), exact)
            yield rows, x, best, distance


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and q (64 integers, floor(256 * x)) of the vectors with exactly 64 components, none null or non-finite.

    A component of 2**62 or more after scaling raises.
    """
    usable = (F.size("e") == DIMENSIONS) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.when(F.abs(x * 256) < 2.0**62, F.floor(x * 256)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("e", scaled).alias("q"))


def sums_of(centroids: np.ndarray):
    """A task's row for each centroid that is nearest to any of its vectors: cluster, n, s0 to s63."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, DIMENSIONS), dtype=object)
        for _, x, best, _ in blocks(batches, centroids):
            count += np.bincount(best, minlength=k)
            for j in np.unique(best):
                mine = x[best == j]
                wide = max(abs(int(mine.max())), abs(int(mine.min()))) >= 1 << 52
                total[j] += (mine.astype(object) if wide else mine).sum(axis=0)
        some = np.flatnonzero(count)
        if len(some):
            columns = [pa.array(some, pa.int32()), pa.array(count[some], pa.int64())]
            columns += [pa.array([int(t) for t in total[some, i]], pa.decimal128(38, 0)) for i in range(DIMENSIONS)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *[f"s{i}" for i in range(DIMENSIONS)]])

    return run


SUMS_DDL = "cluster int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(DIMENSIONS))


def assigned_to(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, best, distance in blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2") -> DataFrame:
    """One row for each usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``; each round assigns every vector and moves
    the centroids to floor(sum / count). Ties go to the smaller number; empty centroids stay; fewer than ``k`` vectors give fewer
    centroids. Repeated rows each have a row (and may be several centroids); of rows with one vec_id the smaller vector comes
    first; null vec_ids come last. Vectors null, of another length, or with a null or non-finite component have no row. Exact for components up to 2**62; a distance
    beyond 64 bits raises. No usable vectors give no rows; other columns aren't read.
    """
    spark = embeddings.sparkSession
    stages = Stages(spark, "centroids")
    vectors = stages.put("vectors", quantised(embeddings))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(named.asc_nulls_last(), "q").limit(k).select("q").collect()  # k rows
    centroids = np.array([r["q"] for r in start], dtype=np.int64).reshape(-1, DIMENSIONS)
    for _ in range(rounds if len(start) else 0):
        sums = vectors.mapInArrow(sums_of(centroids), SUMS_DDL).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMENSIONS)])
        for r in sums.collect():  # k rows
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIMENSIONS)]
    if not len(start):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = stages.put("assigned", vectors.mapInArrow(assigned_to(centroids), "vec_id long, cluster int, distance long"))
    spread = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, d, sum(spread.values()), names[j]) for j, d in spread.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
