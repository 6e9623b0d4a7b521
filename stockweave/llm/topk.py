"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt into blocks of a bounded number of rows and queries into chunks; each (block, chunk) is a task of its own.
A task sorts its block once by every dimension. For a query it walks all lists at once, from the largest values where
the query's component is positive and from the smallest where it is negative, scores what it has not seen yet, and stops
when the sum of the products at the present depth, which no unseen vector can exceed, is below its kth best score. The
best k of each block are merged per query. With vectors spread evenly in many dimensions the bound falls slowly and most of
a block is scored; the result is exact in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, CHUNK_ROWS = 16_384, 1_024
FOUND = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); vectors that are null or hold null, NaN or infinity go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def pack(rows: pa.Table) -> pa.Table:
    """One row for a block: ids and components as raw 64-bit integers; a repeated row counts once."""
    ids = rows.column("vec_id").to_numpy()
    values = rows.column("v").combine_chunks()
    matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    both = np.unique(np.column_stack([ids, matrix]), axis=0)
    return pa.table({"dim": rows.column("dim")[:1], "part": rows.column("part")[:1], "ids": [both[:, 0].tobytes()], "matrix": [np.ascontiguousarray(both[:, 1:]).tobytes()]})


def unpack(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype=np.int64)
    return ids, np.frombuffer(matrix, dtype=np.int64).reshape(len(ids), dim)


def threshold_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of a block for each query, its own id excepted."""
    n, dim = x.shape
    top = [max(1, int(np.abs(m).max(initial=0))) for m in (x, q)]
    if top[0] * top[1] * max(dim, 1) < 1 << 53:  # exact in floating point, which is faster
        x, q = x.astype(np.float64), q.astype(np.float64)
    falling = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)  # list of a dimension: rows from the largest value
    out = []
    for query_id, query in zip(query_ids, q):
        up = query > 0
        active = np.flatnonzero(query)
        seen = np.zeros(n, dtype=bool)
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=x.dtype)
        done, depth = 0, min(n, 64)
        while True:
            before = seen.copy()
            for d in active:
                order = falling[d]
                seen[order[done:depth] if up[d] else order[n - depth : n - done]] = True
            if depth == n or len(active) == 0:
                seen[:] = True
            new = np.flatnonzero(seen & ~before)
            new = new[ids[new] != query_id]
            score = x[new] @ query
            if len(best) == k:
                at_least = score >= best[-1]
                new, score = new[at_least], score[at_least]
            all_ids, all_scores = np.concatenate([best_ids, ids[new]]), np.concatenate([best, score])
            first = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[first], all_scores[first]
            if depth == n or len(active) == 0:
                break
            last = np.where(up[active], falling[active, depth - 1], falling[active, n - depth])
            bound = (query[active] * x[last, active]).sum()
            if len(best) == k and bound < best[-1]:
                break
            done, depth = depth, min(n, depth * 4)
        out.extend((int(query_id), int(i), int(s)) for i, s in zip(best_ids, best))
    return out


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for every query, ties to the smaller id.

    ``vectors`` has vec_id and v (integers, no nulls inside). Vectors are compared with those of their own length; a repeated
    row counts once, and rows that share an id are all left out of its own search. Fewer than k others give fewer rows.
    """
    sized = vectors.filter("v is not null and vec_id is not null").select("vec_id", "v", F.size("v").alias("dim"))
    n, queries = sized.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(queries / chunk_rows))

    def packed(rows: DataFrame, parts: int) -> DataFrame:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        return dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, part int, ids binary, matrix binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for dim, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids, x = unpack(raw[0], raw[1], dim)
                found = threshold_search(ids, x, *unpack(raw[2], raw[3], dim), k)
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*found)))) if found else {c: [] for c in schema.names}, schema=schema)

    asked = packed(sized.filter(is_query), chunks).select("dim", F.col("part").alias("chunk"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))
    held = packed(sized, blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    pairs = held.join(asked, ["dim", "chunk"]).select("dim", "ids", "matrix", "q_ids", "q", "part", "chunk")
    dealt = pairs.repartition(max(1, min(blocks * chunks, 4096)), "dim", "part", "chunk").select("dim", "ids", "matrix", "q_ids", "q")
    found = dealt.mapInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
