"""Filter interaction audit: contingency tensor contractions.

Each document passes or fails five filters. A part's documents are counted into a tensor of shape 2 x 2 x 2 x 2 x 2 (pass or fail
on each axis), once for all documents, once for good and once for toxic ones. What a filter removes at a step of an order is the
contraction of that tensor with one selector for each axis: pass for the filters before it, fail for itself, all for those after
it. One einsum gives all orders and steps at once, so the texts are read once and not once for each order.

Copies are found by a SHA-256 of the text. Documents meet on (doc_id) for their labels and then on (digest, part) for their copies;
both groupings are summed before the exchange, so a text that a third of all documents share is one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKUP = 200, 50, 3, b"#$%&*|"
CAPITALS, CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
MEASURES = ["n", "good", "toxic"]
#: Selectors of an axis: pass, fail, all.
PASS, FAIL, ALL = 0, 1, 2
SELECT = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)


def text_fails(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A in bit 0."""
    words = text.split()
    points = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marked = len(text) != len(text.translate(None, MARKUP))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | marked << 3


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        fails = pa.array([text_fails(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), fails, digests], names=["doc_id", "part", "fails", "digest"])


def contingency(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: a row for each cell that has documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), utf8("text"))
    docs = docs.mapInArrow(describe, "doc_id long, part string, fails int, digest binary")
    # rows without an id meet no label; their digest spreads them
    docs = docs.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0).cast("long"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = docs.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    each = marked.groupBy("doc_id", "salt", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("good", "toxic")])
    nameless = [F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col(m))), F.lit(0)).alias(f"{m}_0") for m in MEASURES]
    copies = each.groupBy("digest", "part", "fails").agg(*[F.sum(m).alias(m) for m in MEASURES], *nameless, F.min("doc_id").alias("first"), F.min_by(F.struct(*MEASURES), "doc_id").alias("lead"))
    copies = copies.withColumn("least", F.min("first").over(Window.partitionBy("digest")))  # a row for each part of a text
    leads = F.col("first") == F.col("least")
    passed = {m: F.col(f"{m}_0") + F.when(leads, F.col(f"lead.{m}")).otherwise(0) for m in MEASURES}
    split = F.explode(F.array(F.struct(F.col("fails"), *[passed[m].alias(m) for m in MEASURES]), F.struct((F.col("fails") + 16).alias("fails"), *[(F.col(m) - passed[m]).alias(m) for m in MEASURES])))
    cells = copies.select("part", split.alias("c")).filter("c.n > 0")
    return cells.groupBy("part", F.col("c.fails").alias("fails")).agg(*[F.sum(f"c.{m}").cast("long").alias(m) for m in MEASURES])


def tensor(fails: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """Counts of shape (2, 2, 2, 2, 2, measures), axes in the order of FILTERS; index 1 is fail."""
    flat = np.zeros((32, measures.shape[1]), dtype=np.int64)
    np.add.at(flat, fails, measures)
    return flat.reshape(2, 2, 2, 2, 2, -1).transpose(4, 3, 2, 1, 0, 5)  # bit 0 (A) varies fastest


def contract(counts: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Sums of the tensor for each row of axis selectors: (rows, 5) -> (rows, measures)."""
    picks = SELECT[axes]
    return np.einsum("abcdem,ra,rb,rc,rd,re->rm", counts, *picks.transpose(1, 0, 2), optimize=True)


def selectors() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The filter of each of the (order, step) rows, and the axis selectors of each figure."""
    place = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    rank = np.argsort(place, axis=1)[:, None, :]  # of each filter in its order
    step = np.arange(len(FILTERS))[None, :, None]
    own = rank == step
    figures = {
        "kept": np.where(rank <= step, PASS, ALL),
        "removed": np.where(own, FAIL, np.where(rank < step, PASS, ALL)),
        "failing": np.where(own, FAIL, ALL),
        "unique": np.where(own, FAIL, PASS),
    }
    return place.ravel(), {k: np.broadcast_to(v, (len(ORDERS), 5, 5)).reshape(-1, 5) for k, v in figures.items()}


AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])
AUDIT_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_part(cells: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its 32 cells at most."""
    measures = np.stack([cells.column(m).to_numpy() for m in MEASURES], axis=1)
    counts = tensor(cells.column("fails").to_numpy(), measures)
    own, axes = selectors()
    kept, removed, failing, unique = (contract(counts, axes[k]) for k in ("kept", "removed", "failing", "unique"))
    shapley = np.zeros(len(FILTERS), dtype=np.int64)
    np.add.at(shapley, own, removed[:, 0])
    columns = [kept[:, 0], removed[:, 0], failing[:, 0] - removed[:, 0], unique[:, 0], removed[:, 1], removed[:, 2], shapley[own]]
    rows = len(own)
    names = [pa.array([cells.column("part")[0].as_py()] * rows, pa.string()), pa.array(np.repeat(ORDERS, 5), pa.string()), pa.array(np.tile(np.arange(1, 6), len(ORDERS)), pa.int32())]
    return pa.Table.from_arrays([*names, *[pa.array(c, pa.int64()) for c in columns]], schema=AUDIT)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang, null as the empty string), filter_order and step.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals > 3 * code points; D: any of ``#$%&*|``; E: a
    smaller doc_id has the same text. kept: left after the step; removed: by it; redundant: fail its filter but went earlier;
    unique_fails: fail its filter only; good_lost and toxic_lost: removed with such a label; shapley: removed by its filter in all orders.

    Null text is empty (and equal to empty). Repeated rows count each; of rows with the same doc_id and text none fails E for the
    other. A null doc_id has no label, is never smaller than another and passes E. Of several labels of a document any 1 counts.
    No documents give no rows; other columns aren't read.
    """
    return contingency(documents, labels).groupBy("part").applyInArrow(audit_part, AUDIT_DDL)
