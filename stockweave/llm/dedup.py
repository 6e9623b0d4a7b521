"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each partition (*unit*) reduces its texts to SHA-256 and a fingerprint, and sends every owner the sorted distinct
   fingerprints of that owner's range, Golomb-Rice coded.
2. An owner marks the fingerprints that more than one unit sent and answers each unit with a bitmap.
3. A unit's suspects are the rows that the bitmap marks or that the unit itself holds twice. Only their texts are
   shuffled and compared byte by byte, as the grouping key of an aggregation with map-side combine, so that a group of
   copies of any size meets as one row for each task.

A hot text is one fingerprint for each unit, whatever its number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import SPACES, Stages, unused, utf8, width

#: Bits of a fingerprint. Chance matches only add suspects, which the byte comparison clears.
PRINT_BITS = 48
#: Rows of one unit at most; a task with more sends several.
UNIT_ROWS = 200_000


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct integers below 2**bits: the gaps' quotients in unary, then their remainders in k bits each."""
    n = len(values)
    if n == 0:
        return b""
    k = max(0, bits - int(n).bit_length())
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
    low = ((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    head = np.array([n, k, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    n, k, length = (int(x) for x in np.frombuffer(data, dtype="<u4", count=3))
    raw = np.frombuffer(data, dtype=np.uint8, offset=12)
    cut = (length + 7) // 8
    quotients = np.diff(np.flatnonzero(np.unpackbits(raw[:cut], count=length)), prepend=-1) - 1
    low = np.unpackbits(raw[cut:], count=n * k).reshape(n, k).astype(np.int64)
    gaps = (quotients << k) + (low @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0)
    return np.cumsum(gaps)


SENT = pa.schema([("unit", pa.int64()), ("owner", pa.int32()), ("doc_id", pa.int64()), ("n_cp", pa.int64()), ("sha", pa.binary()), ("blob", pa.binary())])
SENT_DDL = "unit long, owner int, doc_id long, n_cp long, sha binary, blob binary"


def prints(sha: list[bytes]) -> np.ndarray:
    """Fingerprints: the first bits of the digests."""
    first = np.frombuffer(b"".join(s[:8] for s in sha), dtype=">u8").astype(np.uint64)
    return (first >> np.uint64(64 - PRINT_BITS)).astype(np.int64)


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values >> (PRINT_BITS - 24)) * owners >> 24).astype(np.int32)


def send(owners: int):
    """Rows of the documents (``blob`` null) and, after each unit, its coded fingerprints for each owner (``sha`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, kept = TaskContext.get().partitionId() << 20, 0, []

        def close() -> pa.RecordBatch:
            values = np.unique(np.concatenate(kept))
            to = owner_of(values, owners)
            blobs = {int(o): golomb_encode(values[to == o], PRINT_BITS) for o in np.unique(to)}
            n = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array([base + k] * n, pa.int64()), pa.array(list(blobs), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(list(blobs.values()), pa.binary())], schema=SENT)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            sha = [hashlib.sha256(t.translate(None, SPACES)).digest() for t in texts]
            values = prints(sha)
            kept.append(values)
            # code points: bytes that don't continue a UTF-8 sequence
            sizes = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts]
            n = len(sha)
            yield pa.RecordBatch.from_arrays([pa.array([base + k] * n, pa.int64()), pa.array(owner_of(values, owners)), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sha, pa.binary()), pa.nulls(n, pa.binary())], schema=SENT)
            if sum(map(len, kept)) >= UNIT_ROWS:
                yield close()
                k, kept = k + 1, []
        if kept:
            yield close()

    return run


def answer(rows: pa.Table) -> pa.Table:
    """One owner: for each unit a bitmap over what it sent, set where another unit sent the same."""
    blobs = [golomb_decode(b) for b in rows.column("blob").to_pylist()]
    values, counts = np.unique(np.concatenate(blobs), return_counts=True)
    twice = values[counts > 1]
    maps = [np.packbits(np.isin(b, twice, assume_unique=True)).tobytes() for b in blobs]
    return pa.table({"unit": rows.column("unit"), "owner": rows.column("owner"), "bitmap": pa.array(maps, pa.binary())})


def suspects(docs: pa.Table, maps: pa.Table) -> pa.Table:
    """One unit and owner: the rows whose bit is set, or whose fingerprint the unit holds more than once."""
    if docs.num_rows == 0:
        return docs.select(["doc_id", "sha"])
    values, back, counts = np.unique(prints(docs.column("sha").to_pylist()), return_inverse=True, return_counts=True)
    bits = np.unpackbits(np.frombuffer(maps.column("bitmap")[0].as_py(), dtype=np.uint8), count=len(values)).astype(bool)
    return docs.select(["doc_id", "sha"]).filter(pa.array((bits | (counts > 1))[back]))


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the one with the most
    code points stays, then the smallest doc_id. A repeated row counts in ``group_size`` and has a row of its own. A null
    doc_id is the largest. Only doc_id and text are read. No rows give no rows.
    """
    spark = documents.sparkSession
    stages = Stages(spark, "exact")
    owners = width(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text"))
    sent = stages.put("sent", texts.mapInArrow(send(owners), SENT_DDL))
    docs = sent.filter("blob is null").select("unit", "owner", "doc_id", "n_cp", "sha")
    maps = sent.filter("blob is not null").groupBy("owner").applyInArrow(answer, "unit long, owner int, bitmap binary")
    marked = stages.put("suspects", docs.groupBy("unit", "owner").cogroup(maps.groupBy("unit", "owner")).applyInArrow(suspects, "doc_id long, sha binary"))

    # byte verification: the whole normalised text is the key
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = marked.select("doc_id").distinct().withColumnRenamed("doc_id", "s")
    shuffled = whole.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s")), "left_semi")
    norm = F.translate("text", SPACES.decode(), "")
    best = F.max(F.struct(F.length("text").alias("n_cp"), (-F.col("doc_id")).alias("neg"))).alias("best")
    groups = shuffled.select("doc_id", "text", norm.alias("norm")).groupBy("norm").agg(best, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    keys = stages.put("groups", groups.select(F.unhex(F.sha2("norm", 256)).alias("g"), (-F.col("best.neg")).alias("keep"), "group_size"))

    out = docs.join(keys, docs.sha == keys.g, "left")
    keep = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that stay, all columns; repeated rows of one doc_id and text count once."""
    name = unused("kept")
    kept = exact_groups(documents).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    stay = documents.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])
