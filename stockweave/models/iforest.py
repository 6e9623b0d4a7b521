"""Isolation forest on whole numbers: bottom-k subsamples, one tree per group, scores per partition.

Features enter in ten-thousandths, tickets and splits come from MD5, and path lengths are kept in millionths, so all that decides a
tree or a score is integer arithmetic: it doesn't depend on partitioning or on the engine.

Each tree learns from the 256 rows with the smallest tickets. A row's MD5 gives two numbers below 2**31 - 1, and a tree has its own
permutation of each, so no row is copied for the trees: a task keeps the 256 smallest tickets of each tree while it reads and sends
those, and the reducer keeps the smallest of what tasks send. Both hold trees x 256 rows at any size of the input. The finished
forest (at most 511 nodes a tree) travels with the scoring function.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_TREES = 100
SAMPLE_ROWS = 256
EULER_GAMMA = 0.5772156649015329
PRIME = (1 << 31) - 1
#: Units of a feature and of a path length; features are clipped so that products stay within 64 bits.
FEATURE_UNIT, PATH_UNIT, CLIP = 10_000, 1_000_000, 1e8
#: Steps of the place of a split between a node's least and greatest value.
CUT_STEPS = 1 << 20
NODE_SCHEMA = "tree int, node int, feature int, threshold long, path long"


def average_path(n: int) -> int:
    """Mean depth of an unsuccessful search among n rows, in millionths."""
    if n <= 1:
        return 0
    if n == 2:
        return PATH_UNIT
    return round(PATH_UNIT * (2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n))


def number(text: str, digits: int) -> int:
    """The first hex digits of a text's MD5 as a number."""
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def permutations(seed: int, n_trees: int) -> list[tuple[int, int, int, int]]:
    """Factor and offset of both halves of the tickets, for each tree."""
    part = lambda t, name: number(f"{seed}:{t}:{name}", 8) % (PRIME - 1)
    return [(part(t, "a") + 1, part(t, "b"), part(t, "c") + 1, part(t, "d")) for t in range(n_trees)]


def whole(value: Column) -> Column:
    """A feature in ten-thousandths; the cut sits off exact halves so that last-bit differences cannot flip it. NULL counts as 0."""
    clipped = F.least(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(-CLIP)), F.lit(CLIP))
    return F.floor(clipped * FEATURE_UNIT + 0.5003).cast("long")


def row_numbers(row_key: Sequence[str]) -> list[Column]:
    """The two numbers of a row, from the MD5 of its key; NULL key columns are skipped."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in row_key]).cast("binary"))
    return [(F.conv(F.substring(digest, at, 12), 16, 10).cast("long") % PRIME).alias(name) for at, name in ((1, "_h1"), (13, "_h2"))]


def _keep_least(rows: np.ndarray) -> np.ndarray:
    """The sample of one tree: the rows with the smallest tickets (first column), then feature values."""
    if len(rows) > SAMPLE_ROWS:
        edge = np.partition(rows[:, 0], SAMPLE_ROWS - 1)[SAMPLE_ROWS - 1]
        rows = rows[rows[:, 0] <= edge]
    return rows[np.lexsort(rows.T[::-1])][:SAMPLE_ROWS]


def _sampled(names: Sequence[str], seed: int, n_trees: int, combine: bool):
    """Bottom-k rows of each tree: of the rows read, or (``combine``) of what tasks have sent."""
    columns = ["ticket", *names]

    def send(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        trees = pa.array(np.repeat(list(held), [len(x) for x in held.values()]), pa.int32())
        rows = np.concatenate(list(held.values()))
        return pa.RecordBatch.from_arrays([trees, *[pa.array(rows[:, i]) for i in range(len(columns))]], names=["tree", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        turns = permutations(seed, n_trees)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            if combine:
                trees, tickets = batch.column("tree").to_numpy(), batch.column("ticket").to_numpy()
                fresh = {int(t): np.column_stack([tickets, values])[trees == t] for t in np.unique(trees)}
            else:
                one, two = batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()
                fresh = {}
                for t, (a, b, c, d) in enumerate(turns):
                    first = (one * a + b) % PRIME
                    worst = held[t][-1, 0] >> 31 if t in held and len(held[t]) == SAMPLE_ROWS else PRIME
                    if len(first) > SAMPLE_ROWS:
                        worst = min(worst, np.partition(first, SAMPLE_ROWS - 1)[SAMPLE_ROWS - 1])
                    at = np.flatnonzero(first <= worst)
                    fresh[t] = np.column_stack([(first[at] << 31) + (two[at] * c + d) % PRIME, values[at]])
            for t, rows in fresh.items():
                if len(rows):
                    held[t] = _keep_least(np.concatenate([held[t], rows]) if t in held else rows)
        if held:
            yield send(held)

    return run


def _grow(features: Sequence[str], seed: int):
    def grow_tree(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows[list(features)].to_numpy(dtype=np.int64)
        limit = max(len(x) - 1, 1).bit_length()
        nodes: list[tuple] = []
        open_nodes = [(1, np.arange(len(x)), 0)]
        while open_nodes:
            node, members, depth = open_nodes.pop()
            part = x[members]
            lo, hi = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or not len(usable):
                nodes.append((tree, node, -1, 0, depth * PATH_UNIT + average_path(len(members))))
                continue
            feature = int(usable[number(f"{seed}:{tree}:{node}:feature", 8) % len(usable)])
            # strictly below the greatest value, so neither side is empty
            span = int(hi[feature] - lo[feature])
            threshold = int(lo[feature]) + (span * number(f"{seed}:{tree}:{node}:cut", 5)) // CUT_STEPS
            left = part[:, feature] <= threshold
            nodes.append((tree, node, feature, threshold, 0))
            open_nodes += [(2 * node, members[left], depth + 1), (2 * node + 1, members[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return grow_tree


def _scorer(forest: list[dict[str, np.ndarray]], n_sample: int):
    norm = max(average_path(n_sample), 1) * len(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x = batch.to_numpy(dtype=np.int64)
            path = np.zeros(len(x), dtype=np.int64)
            for t in forest:
                at = np.ones(len(x), dtype=np.int64)
                inner = t["feature"][at] >= 0
                while inner.any():
                    rows = np.flatnonzero(inner)
                    here = at[rows]
                    at[rows] = 2 * here + (x[rows, t["feature"][here]] > t["threshold"][here])
                    inner[rows] = t["feature"][at[rows]] >= 0
                path += t["path"][at]
            yield pd.Series(np.power(2.0, -path / norm))

    return score


def isolation_scores(data: DataFrame, features: Sequence[str], row_key: Sequence[str], seed: int = 42, n_trees: int = N_TREES) -> DataFrame:
    """Adds ``iforest_score`` in (0, 1]; higher is more unusual. Fits on the given rows.

    NULL features count as 0. Rows with one key draw the same tickets. No rows give no rows.
    """
    names = [f"_f_{c}" for c in features]
    ready = data.withColumns({n: whole(F.col(c)) for n, c in zip(names, features)})
    numbered = ready.select(*row_numbers(row_key), *names)
    schema = ", ".join(["tree int", "ticket long", *[f"{n} long" for n in names]])
    sent = numbered.mapInArrow(_sampled(names, seed, n_trees, combine=False), schema)
    width = min(n_trees, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    samples = sent.repartition(width, "tree").mapInArrow(_sampled(names, seed, n_trees, combine=True), schema)
    nodes = samples.groupBy("tree").applyInPandas(_grow(names, seed), NODE_SCHEMA).toPandas()  # n_trees x 511 nodes at most
    if nodes.empty:
        return data.withColumn("iforest_score", F.lit(None).cast("double"))
    forest = []
    for _, tree in nodes.groupby("tree"):
        size = int(tree["node"].max()) + 1
        laid = {c: np.full(size, -1 if c == "feature" else 0, dtype=np.int64) for c in ("feature", "threshold", "path")}
        for c, values in laid.items():
            values[tree["node"].to_numpy()] = tree[c].to_numpy()
        forest.append(laid)
    n_sample = min(SAMPLE_ROWS, data.limit(SAMPLE_ROWS).count())
    return ready.withColumn("iforest_score", _scorer(forest, n_sample)(F.struct(*names))).drop(*names)
