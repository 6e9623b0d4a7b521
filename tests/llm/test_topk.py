import numpy as np
from pyspark.sql import functions as F

from stockweave.llm import topk


def brute(rows, k):
    out = set()
    for qid, q in rows:
        if qid % 50:
            continue
        best = sorted({(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)})[:k]
        out |= {(qid, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def search(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, v array<long>, dim int, part int")
    return [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect()]


def test_equals_brute_force_over_blocks_and_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-9, 10, 6)]) for i in range(400)]  # small values: many ties
    rows += [(1000 + i, [9, 0, 0, 0, 0, 0]) for i in range(130)] + [(2000, [0] * 6), (2050, [1, 2]), (2051, [2, 2])]
    got = search(spark, rows, block_rows=97, chunk_rows=5)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_stops_early_where_lists_allow_it():
    rng = np.random.default_rng(2)
    x = rng.integers(-5, 5, (5000, 3))
    x[:8] = 1000
    found = topk.threshold_search(np.arange(5000), x, np.array([-1]), np.array([[3, 2, 1]]), 5)
    assert [f[1] for f in found] == [0, 1, 2, 3, 4]


def test_large_values_stay_exact():
    x = np.array([[1 << 31, 3], [1 << 31, 2], [5, 5]])
    assert topk.threshold_search(np.arange(3), x, np.array([9]), np.array([[1 << 30, 1]]), 2) == [(9, 0, (1 << 61) + 3), (9, 1, (1 << 61) + 2)]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, v int"
    nan = float("nan")
    df = spark.createDataFrame([(0, [0.5, -0.001], 1, 1), (1, None, 1, 1), (2, [None, 1.0], 1, 1), (3, [nan, 1.0], 1, 1), (4, [float("inf"), 1.0], 1, 1), (5, [1.0, 1.0], 1, 1), (5, [1.0, 1.0], 1, 1)], schema)
    rows = [tuple(r) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect()]
    assert rows == [(0, 1, 5, 128 * 256 - 256)]
    assert topk.top_k(topk.quantised(df.filter("false")), F.col("vec_id") % 50 == 0).collect() == []
