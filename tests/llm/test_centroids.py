import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, label int, q string, cluster string, distance int, n int"


def brute(rows, k, rounds):
    """Plain integers all the way; rows of (vec_id, components)."""
    use = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    start = sorted(use, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    cents = [v for _, v in start]
    near = lambda v: min(range(len(cents)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, cents[j])), j))
    for _ in range(rounds):
        at = [near(v) for _, v in use]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(use, at) if a == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at = [near(v) for _, v in use]
    dist = [sum((a - b) ** 2 for a, b in zip(v, cents[j])) for (_, v), j in zip(use, at)]
    per = {j: sum(d for d, a in zip(dist, at) if a == j) for j in set(at)}
    return sorted((i, j, d, per[j], sum(dist), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), j, d in zip(use, at, dist))


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, e, 1, "q", "c", 2, 3) for i, e in rows], SCHEMA)
    return sorted(tuple(r) for r in C.cluster(df, **how).collect())


def test_equals_brute_force_with_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) / 256]) for i in range(150)]  # few values: ties
    rows += [rows[0]] * 30 + [(7, rows[9][1]), (500, [0.0] * 64), (501, [0.0] * 64)]
    assert run(spark, rows, k=9, rounds=3) == brute(rows, 9, 3)
    smooth = [(i, [float(x) for x in rng.normal(size=64) * (5 if i % 3 else 40)]) for i in range(120)]
    assert run(spark, smooth, k=40, rounds=5) == brute(smooth, 40, 5)


def test_a_centroid_without_vectors_stays_and_few_vectors_give_few_centroids(spark):
    same = [(i, [1.0] * 64) for i in range(5)]
    got = run(spark, same)
    assert got == brute(same, 40, 5) and {r[1] for r in got} == {0}


def test_components_beyond_the_quick_path_are_exact(spark):
    rows = [(1, [1e5] * 64), (2, [1e5] * 63 + [1e5 + 1 / 256]), (3, [-3e5] * 64), (4, [2.0**45] * 64), (5, [2.0**45] * 64)]
    assert run(spark, rows, k=4, rounds=2) == brute(rows, 4, 2)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e300] * 64)])


def test_unusable_vectors_have_no_row(spark):
    ok = [0.5] * 64
    rows = [(1, ok), (2, None), (3, ok[:63]), (4, [*ok[:63], None]), (5, [*ok[:63], float("nan")]), (6, [*ok[:63], float("-inf")]), (7, [*ok, 0.1]), (8, [])]
    assert [r[0] for r in run(spark, rows)] == [1]
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_null_ids_take_part_and_start_last(spark):
    rows = [(None, [0.1] * 64), (3, [0.2] * 64), (None, [0.9] * 64)]
    got = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, rounds=0).collect()
    assert len(got) == 3 and {r.cluster for r in got if r.vec_id == 3} == {0}


def test_transform_keeps_distances_and_goes_coarse_to_fine():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (50, 64))
    t = C.transform(x)
    assert ((t[0] - t[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    assert (t[:, 0] == x.sum(axis=1)).all()
    signs = C.transform(np.eye(64, dtype=np.int64)).T  # row i: the pattern of coefficient i
    assert [int((r[1:] != r[:-1]).sum()) for r in signs] == list(range(64))


def test_search_drops_centroids_early_where_the_coarse_shape_tells():
    level = np.arange(30)[:, None] * np.ones((1, 64), dtype=np.int64) * 100
    rng = np.random.default_rng(0)
    x = level[rng.integers(0, 30, 200)] + rng.integers(-3, 4, (200, 64))
    best, distance, compared = C.nearest(C.transform(x), C.transform(level))
    want = ((x[:, None, :] - level[None]) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert compared < 0.1 * 200 * 30 * 64


def test_one_hot_cluster_is_summed_in_the_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[(F.when(F.col("id") < 2990, 0.25).otherwise(F.col("id") * 0.01)).cast("float") for _ in range(64)]).alias("embedding"))
    got = C.cluster(df, k=5, rounds=2)
    assert got.count() == 3000 and got.agg(F.sum("distance")).first()[0] == got.first().inertia
