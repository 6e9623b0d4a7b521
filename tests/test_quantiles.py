import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockweave.functions.quantiles import _bucket, finalize, grouped_quantiles
from tests.util import frame

WANTED = {"lo": ("v", 0.05), "mid": ("v", 0.5), "hi": ("v", 0.9), "other": ("w", 0.75)}


def check(spark, groups: dict, per_octave: int):
    rows = [(k, float(v), float(2 * v + 1)) for k, values in groups.items() for v in values]
    got = {r.k: r for r in grouped_quantiles(frame(spark, rows, "k string, v double, w double"), ["k"], WANTED, per_octave).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        v = np.array(values, dtype=float)
        for name, (col, q) in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(v if col == "v" else 2 * v + 1, q), rel=1e-9, abs=1e-9), (k, name)


@pytest.mark.parametrize("per_octave", [1, 256])
def test_matches_numpy_with_a_hot_group_ties_and_null_key(spark, per_octave):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.lognormal(size=6000), "ties": np.repeat([0.0, 0.0, 0.0, 5.0], 500), "one": [3.0], "two": [1.0, 2.0], None: rng.normal(size=40)}
    check(spark, groups, per_octave)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_groups_are_exact_on_any_input(spark, values):
    check(spark, {"a": values}, 2)


def test_nulls_are_skipped_and_no_keys_give_one_row(spark):
    df = frame(spark, [(1.0,), (None,), (3.0,)], "v double")
    assert grouped_quantiles(df, [], {"m": ("v", 0.5)}, 1).collect()[0].m == 2.0


@pytest.mark.parametrize("per_octave", [1, 256])
def test_equals_the_built_in_percentile(spark, per_octave):
    rng = np.random.default_rng(2)
    rows = [("giant", float(x)) for x in rng.normal(size=3000)] + [("nulls", None)] * 3 + [("ties", 2.0)] * 500 + [(None, None), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", float("inf"))]
    df = frame(spark, rows, "k string, v double").repartition(4)
    levels = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.99, "q4": 1.0}
    got = {r.k: r for r in grouped_quantiles(df, ["k"], {n: ("v", q) for n, q in levels.items()}, per_octave).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in levels.items()]).collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        for n in levels:
            a, b = got[k][n], row[n]
            assert (a is None and b is None) or a == b or (a != a and b != b) or abs(a - b) < 1e-9, (k, n, a, b)


def test_no_rows_with_and_without_keys(spark):
    df = frame(spark, [], "k string, v double")
    assert grouped_quantiles(df, ["k"], {"m": ("v", 0.5)}).collect() == []
    assert [r.m for r in grouped_quantiles(df, [], {"m": ("v", 0.5)}).collect()] == [None]


def test_input_is_read_once_and_counted_before_it_is_exchanged(spark, tmp_path):
    frame(spark, [(str(i % 3), float(i)) for i in range(100)], "k string, v double").write.parquet(f"{tmp_path}/t")
    df = grouped_quantiles(spark.read.parquet(f"{tmp_path}/t"), ["k"], {"m": ("v", 0.5)})
    assert len(df.collect()) == 3
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final[: final.index("Initial Plan")]
    scans = [i for i, line in enumerate(final.splitlines()) if "FileScan parquet" in line]
    assert len(scans) == 1 and "ReusedExchange" in final
    above = final.splitlines()[: scans[0]][::-1]
    exchange = next(i for i, line in enumerate(above) if "Exchange" in line)
    # dealt by group, column and value
    assert any("partial_count" in line for line in above[:exchange]) and above[exchange].count("#") == 3


@pytest.mark.parametrize("per_octave", [1, 256])
def test_buckets_never_fall_as_values_grow(spark, per_octave):
    rng = np.random.default_rng(4)
    near = [1.0, 2.0, 4.0, 1e-300, 5e-324, 1e300, 0.1, 3.0]
    values = [0.0, float("inf"), float("-inf"), *near, *[float(np.nextafter(x, 0)) for x in near], *[float(np.nextafter(x, 9e300)) for x in near], *rng.lognormal(sigma=9, size=2000)]
    values = sorted(float(x) for v in values for x in (v, -v))
    got = [r.b for r in frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v double").select("i", _bucket(F.col("v"), per_octave).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_finalize_keeps_what_is_missing(spark):
    df = frame(spark, [(1, 5.0, None, -3.0, 2.0, 9.0)], "id int, q05 double, q10 double, q50 double, q90 double, q95 double")
    r = finalize(df).collect()[0]
    assert [r.q05, r.q10, r.q50, r.q90, r.q95] == [5.0, None, 0.0, 2.0, 9.0]


def test_finalize_clips_and_sorts(spark):
    df = frame(spark, [(1, 5.0, -1.0, 3.0, 2.0, 9.0)], "id int, q05 double, q10 double, q50 double, q90 double, q95 double")
    r = finalize(df).collect()[0]
    assert [r.q05, r.q10, r.q50, r.q90, r.q95] == [0.0, 2.0, 3.0, 5.0, 9.0]
