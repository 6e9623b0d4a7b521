"""Global boosted trees with pinball loss: one model for all series and steps at each origin, all origins trained at once.

Every row carries its features as small bin numbers (cut once, at approximate quantiles of the feature values) and a bit for each
model it may teach. A tree is symmetric: all nodes of a level share one split, so it is a handful of (feature, bin) pairs and a leaf
is the number that their answers spell. One pass over the rows gives, for a level of all trees of all models, the counts keyed
(model, tree, node, feature, bin, class), summed in the tasks before they are exchanged. The class of a row is how many of the
predicted quantiles lie above its target, which fixes the gradient of every level's pinball loss; so all that is summed are counts,
and a model doesn't depend on how the rows are dealt. A last pass refits each leaf to the residual quantile of each level, from counts
on a fixed grid of residuals. Quantiles that cross are sorted in the forecast.

What tasks exchange has the size of the trees and not of the rows; the driver gets one split for each tree and level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.quantiles import finalize
from stockweave.models.features import CALENDAR_COLS, LEVEL_COLS
from stockweave.params import LEVELS, QCOLS, SERIES
from stockweave.sources.staging import spread

# The ABC and XYZ classes and their combinations, in order; anything else has no code.
CLASS_LABELS = {
    "cluster": [f"{a}-{x}" for a in "ABC" for x in "XYZ"],
    "abc_class": list("ABC"),
    "xyz_class": list("XYZ"),
}
FEATURES = ("h", *[c for c in LEVEL_COLS if c != "scale"], "lag52_target", *CALENDAR_COLS, "upc_stat", "cedis_stat", *[f"{c}_code" for c in CLASS_LABELS])
#: Bin 0 is a missing value; the others are cut at approximate quantiles.
BINS, BIN_ACCURACY = 32, 1000
#: Residuals on a grid that is symmetric and geometric, fine near 0.
_POSITIVE = np.geomspace(1e-3, 1e2, 127)
GRID = np.concatenate([-_POSITIVE[::-1], [0.0], _POSITIVE])
N_LEVELS = len(LEVELS)


@dataclass(frozen=True)
class GbtSettings:
    rounds: int = 8
    trees: int = 4
    depth: int = 4
    step: float = 0.5
    row_share: float = 0.8
    column_share: float = 0.5
    rows_per_leaf: int = 40
    shrink: float = 10.0
    seed: int = 42


@dataclass(frozen=True)
class Task:
    """A model to train: it forecasts from ``origin`` and learns from series with ``min_weeks`` observed weeks there."""

    label: str
    fold: int
    origin: date
    min_weeks: int


@dataclass
class Tree:
    columns: np.ndarray
    mix: int
    splits: list[tuple[int, int]] = field(default_factory=list)
    leaves: np.ndarray | None = None


# ------------------------------------------------------------------ rows
def encode(rows: DataFrame) -> DataFrame:
    """The features as doubles, missing values NULL; classes by their place in the closed scheme, ids by their target statistics."""
    codes = {f"{c}_code": F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)), F.lit(0)) for c, labels in CLASS_LABELS.items()}
    coded = rows.withColumns(codes)
    return coded.select(*[c for c in rows.columns if c not in FEATURES], *[F.col(c).cast("double").alias(c) for c in FEATURES])


def cuts(coded: DataFrame) -> list[list[float]]:
    """Upper ends of the bins of each feature but the last, from one aggregation over the rows (those every model may see)."""
    points = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    found = coded.agg(*[F.percentile_approx(F.nanvl(F.col(c), F.lit(None).cast("double")), points, BIN_ACCURACY).alias(c) for c in FEATURES]).first()
    return [sorted(set(found[c] or [])) for c in FEATURES]


def binned(coded: DataFrame, ends: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the bins of a row, one byte for each feature."""
    edges = [np.array(e) for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(FEATURES)), dtype=np.uint8)
            for i, c in enumerate(FEATURES):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                bins[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges[i], x, side="left") + 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([r.tobytes() for r in bins], pa.binary())], names=[*keep, "bins"])

    types = dict(coded.dtypes)
    return coded.select(*keep, *FEATURES).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", bins binary")


def taught(rows: DataFrame, weekly: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """Adds ``models``: bit j is set if the row may teach task j, that is if its target was known at the origin."""
    seen = weekly.filter("y is not null").groupBy(*SERIES).agg(F.array(*[F.count_if(F.col("week_start") <= F.lit(t.origin)) for t in tasks]).alias("_weeks"))
    usable = F.col("y_scaled").isNotNull() & F.col("lag1").isNotNull()
    bits = F.lit(0).cast("long")
    for j, t in enumerate(tasks):
        may = usable & (F.col("target_week") <= F.lit(t.origin)) & (F.get("_weeks", F.lit(j)) >= t.min_weeks)
        bits = bits.bitwiseOR(F.when(may, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.join(seen, list(SERIES), "left").withColumn("models", bits).drop("_weeks")


# ------------------------------------------------------------------ trees
def leaf_of(bins: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """Leaf (or node) numbers; ``bins`` has a row for each feature."""
    at = np.zeros(bins.shape[1], dtype=np.intp)
    for feature, upto in splits:
        at = at * 2 + (bins[feature] > upto)
    return at


def predict(bins: np.ndarray, rounds: list[list[Tree]], step: float) -> np.ndarray:
    """Quantiles of each row, (levels, rows); round 0 is the start and counts in full."""
    out = np.zeros((N_LEVELS, bins.shape[1]))
    for i, trees in enumerate(rounds):
        for tree in trees:
            out += (tree.leaves * (1.0 if i == 0 else step / len(trees))).T[:, leaf_of(bins, tree.splits)]
    return out


def in_sample(ticket: np.ndarray, mix: int, share: float) -> np.ndarray:
    """Whether a row is in a round's sample, by its hash."""
    return ((ticket * np.uint64(mix)) >> np.uint64(40)) < np.uint64(int(share * (1 << 24)))


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


COUNTS_DDL = "model int, tree int, counts binary"


def counting(shared, settings: GbtSettings):
    """A task's counts for each tree of each model: of splits while trees grow, of residuals once they are grown.

    Split counts have the shape (node, column, bin, class), residual counts (leaf, level, grid).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, growing, grown = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for rows in chunks(batches):
            n = rows.num_rows
            whole = np.frombuffer(b"".join(rows.column("bins").to_pylist()), dtype=np.uint8).reshape(n, len(FEATURES)).T
            target = rows.column("y_scaled").to_numpy()
            bits, ticket = rows.column("models").to_numpy(), rows.column("ticket").to_numpy().view(np.uint64)
            for j, rounds in enumerate(models):
                if not growing[j]:
                    continue
                drawn = in_sample(ticket, growing[j][0].mix, settings.row_share) if rounds else True
                mine = np.flatnonzero((bits >> j & 1).astype(bool) & drawn)
                bins, y = np.ascontiguousarray(whole[:, mine]), target[mine]
                now = predict(bins, rounds, settings.step)
                if grown:
                    cell = np.searchsorted(GRID, y - now) + np.arange(N_LEVELS)[:, None] * (len(GRID) + 1)
                else:
                    classes = N_LEVELS + 1
                    above = (y < now).sum(axis=0, dtype=np.intp)
                    scaled = bins.astype(np.intp) * classes
                for k, tree in enumerate(growing[j]):
                    nodes = 1 << len(tree.splits)
                    node = leaf_of(bins, tree.splits)
                    if grown:
                        size = N_LEVELS * (len(GRID) + 1)
                        found = np.bincount((node * size + cell).ravel(), minlength=nodes * size)
                    else:
                        base, size = node * (BINS * classes) + above, nodes * BINS * classes
                        each = np.stack([np.bincount(base + scaled[c], minlength=size) for c in tree.columns])
                        found = each.reshape(len(each), nodes, BINS, classes).transpose(1, 0, 2, 3).ravel()
                    sums[j, k] = sums[j, k] + found if (j, k) in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), pa.array([s.astype(np.int64).tobytes() for s in sums.values()], pa.binary())], names=["model", "tree", "counts"])

    return run


def gradients(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradient of every level from counts by class (last axis): (..., class) -> (...), (..., level)."""
    n = counts.sum(axis=-1)
    # class c: the c highest quantiles lie above the target
    reach = np.array([[1.0 if level >= N_LEVELS - c else 0.0 for level in range(N_LEVELS)] for c in range(N_LEVELS + 1)])
    return n, counts @ reach - n[..., None] * np.array(LEVELS)


def best_split(counts: np.ndarray, columns: np.ndarray, settings: GbtSettings) -> tuple[int, int] | None:
    """The split (feature, last bin of the left side) of a whole level with the largest gain; the first of equals, None without gain."""
    left = counts.cumsum(axis=2)[:, :, :-1]
    n_left, g_left = gradients(left)
    n, g = gradients(counts.sum(axis=2))
    n_right, g_right = n[:, :, None] - n_left, g[:, :, None] - g_left
    weight = 1.0 / (np.array(LEVELS) * (1 - np.array(LEVELS)))
    score = lambda g, n: (g * g * weight).sum(axis=-1) / (n + settings.shrink)
    gain = score(g_left, n_left) + score(g_right, n_right) - score(g, n)[:, :, None]
    gain = np.where((n_left >= settings.rows_per_leaf) & (n_right >= settings.rows_per_leaf), gain, 0.0).sum(axis=0)
    at = int(gain.argmax())
    return (int(columns[at // gain.shape[1]]), at % gain.shape[1]) if gain.flat[at] > 1e-9 else None


def leaf_values(counts: np.ndarray, shrink: float) -> np.ndarray:
    """Residual quantile of each leaf and level, linear inside a grid cell, drawn to 0 where rows are few."""
    ends = np.concatenate([[GRID[0]], GRID, [GRID[-1]]])
    n = counts.sum(axis=-1)
    upto = counts.cumsum(axis=-1)
    rank = np.array(LEVELS) * n
    at = np.minimum((upto < rank[..., None]).sum(axis=-1), len(GRID))
    inside = np.take_along_axis(counts, at[..., None], axis=-1)[..., 0]
    before = np.take_along_axis(upto, at[..., None], axis=-1)[..., 0] - inside
    share = np.where(inside > 0, (rank - before) / np.maximum(inside, 1), 0.0)
    return (ends[at] + share * (ends[at + 1] - ends[at])) * n / (n + shrink)


def deciding(shared, settings: GbtSettings):
    """Sums the tasks' counts of a tree and gives its next split, or its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, growing, grown = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for j, k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(blob, dtype=np.int64)
                sums[j, k] = sums[j, k] + found if (j, k) in sums else found
        out: list[tuple] = []
        for (j, k), counts in sums.items():
            tree = growing[j][k]
            nodes = 1 << len(tree.splits)
            if grown:
                values = leaf_values(counts.reshape(nodes, N_LEVELS, len(GRID) + 1), settings.shrink if models[j] else 0.0)
                out.append((j, k, None, None, values.tobytes()))
            elif split := best_split(counts.reshape(nodes, len(tree.columns), BINS, N_LEVELS + 1), tree.columns, settings):
                out.append((j, k, *split, None))
        if out:
            columns = list(zip(*out))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["model", "tree", "feature", "upto", "leaves"])

    return run


def train(rows: DataFrame, n_models: int, settings: GbtSettings) -> list[list[list[Tree]]]:
    """For each model its rounds of trees, from rows with bins, y_scaled, models and ticket. A model without rows has no round."""
    spark = rows.sparkSession
    known = rows.filter("models <> 0").select("bins", "y_scaled", "models", "ticket")
    rng = np.random.default_rng(settings.seed)
    models: list[list[list[Tree]]] = [[] for _ in range(n_models)]

    def pass_over(growing: list[list[Tree]], grown: bool) -> None:
        shared = spark.sparkContext.broadcast((models, growing, grown))  # trees: bounded by the settings
        counted = known.mapInArrow(counting(shared, settings), COUNTS_DDL)
        tasks = min(n_models, int(spark.conf.get("spark.sql.shuffle.partitions")))
        decided = counted.repartition(tasks, "model", "tree").mapInArrow(deciding(shared, settings), "model int, tree int, feature int, upto int, leaves binary")
        for r in decided.collect():  # a row for each tree
            tree = growing[r["model"]][r["tree"]]
            if grown:
                tree.leaves = np.frombuffer(r["leaves"]).reshape(-1, N_LEVELS)
            else:
                tree.splits.append((r["feature"], r["upto"]))
        shared.destroy()

    start = [[Tree(np.arange(0), 1)] for _ in range(n_models)]
    pass_over(start, grown=True)
    for j, trees in enumerate(start):
        if trees[0].leaves is not None:
            models[j].append(trees)
    wide = max(1, round(settings.column_share * len(FEATURES)))
    for _ in range(settings.rounds):
        mix = int(rng.integers(1 << 62)) * 2 + 1  # the trees of a round learn from one sample of the rows, each from columns of its own
        drawn = [np.sort(rng.permutation(len(FEATURES))[:wide]) for _ in range(settings.trees)]
        growing = [[Tree(columns, mix) for columns in drawn] if m else [] for m in models]
        for _ in range(settings.depth):
            pass_over(growing, grown=False)
        pass_over(growing, grown=True)
        for m, trees in zip(models, growing):
            if fitted := [t for t in trees if t.leaves is not None]:
                m.append(fitted)
    return models


# ------------------------------------------------------------------ forecasts
def forecasts(rows: DataFrame, models: list[list[list[Tree]]], tasks: Sequence[Task], settings: GbtSettings) -> DataFrame:
    """label, fold, series, origin, h, target_week and quantiles, from each origin's newest feature rows."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    which = F.array(*[F.struct(F.lit(j).alias("model"), F.lit(t.label).alias("label"), F.lit(t.fold).alias("fold"), F.lit(t.origin).alias("origin")) for j, t in enumerate(tasks)])
    asked = rows.withColumn("_t", F.explode(F.filter(which, lambda t: t["origin"] == F.col("week_start"))))
    keep = ["label", "fold", *SERIES, "origin", "h", "target_week"]
    asked = asked.select(*[c if c in (*SERIES, "h", "target_week") else f"_t.{c}" for c in keep], "scale", "bins", "_t.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, len(FEATURES)).T
            scale, model = batch.column("scale").to_numpy(zero_copy_only=False), batch.column("model").to_numpy()
            out = np.full((N_LEVELS, batch.num_rows), np.nan)
            for j in np.unique(model):
                at = np.flatnonzero(model == j)
                if shared.value[j]:
                    out[:, at] = np.sort(predict(np.ascontiguousarray(bins[:, at]), shared.value[j], settings.step), axis=0)
            columns = [pa.array(q * scale, pa.float64(), from_pandas=True) for q in out]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *QCOLS])

    types = dict(asked.dtypes)
    return asked.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", " + ", ".join(f"{q} double" for q in QCOLS))


def gbt_quantiles(
    rows: DataFrame, weekly: DataFrame, tasks: Sequence[Task], stage: Callable[[str, Callable[[], DataFrame]], DataFrame], settings: GbtSettings | None = None
) -> DataFrame:
    """Quantile forecasts of the global model for every task (63 at most), all trained in one run; column ``label`` tells whose.

    ``rows`` comes from ``horizon_rows``; ``stage`` materialises an intermediate table. A series without a scale at the origin, or
    a task without any row to learn from, has NULL quantiles.
    """
    s = settings or GbtSettings()
    if len(tasks) > 63:
        raise ValueError("at most 63 models can be trained at once")
    coded = stage("gbt_coded", lambda: encode(rows))
    ticket = F.xxhash64(*SERIES, "week_start", "h").alias("ticket")
    keep = [*SERIES, "week_start", "target_week", "step", "scale", "y_scaled", "models", "ticket"]
    # every pass is heavy per row and reads this table: its files are as many as the session has shuffle partitions
    ready = stage("gbt_rows", lambda: binned(
        spread(taught(coded, weekly, tasks).select("*", F.col("h").cast("int").alias("step"), ticket), "ticket"), cuts(coded.filter(F.col("week_start") <= F.lit(min(t.origin for t in tasks)))), keep
    ).withColumnRenamed("step", "h"))

    def build() -> DataFrame:
        return forecasts(ready, train(ready, len(tasks), s), tasks, s)

    scored = stage("gbt_scored", build)
    return finalize(scored.select("label", "fold", *SERIES, "origin", "h", "target_week", F.lit("gbt").alias("model"), *QCOLS))
