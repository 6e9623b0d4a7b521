"""Exact quantiles of groups of any size, and the row-wise quantile repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.params import QCOLS

#: Buckets of values for each power of two. It decides how large a group's last sorted piece is, never the result.
PER_OCTAVE = 256
#: No double's logarithm lies below.
_LEAST_LOG = 746.0
_NULLS = -(2**31)


def finalize(df: DataFrame) -> DataFrame:
    """Clip the known quantile columns at zero and sort them within each row; a row that lacks one stays as it is."""
    known = F.array(*[F.when(F.col(q).isNotNull(), F.greatest(F.col(q), F.lit(0.0))) for q in QCOLS])
    whole = ~F.exists(known, lambda q: q.isNull())
    rest = [c for c in df.columns if c not in QCOLS]
    return df.withColumn("_q", F.when(whole, F.sort_array(known)).otherwise(known)).select(*rest, *[F.element_at("_q", i + 1).alias(q) for i, q in enumerate(QCOLS)])


def _bucket(v: Column, per_octave: int) -> Column:
    """A number that never falls as the value grows: sign, power of two and its fraction; NaN comes last."""
    size = F.floor((F.log(F.abs(v)) + _LEAST_LOG) * (per_octave / 0.6931471805599453)).cast("int")
    last = 2**31 - 1
    return (
        F.when(F.isnan(v), F.lit(last)).when(v == float("inf"), F.lit(last - 1)).when(v == float("-inf"), F.lit(-last))
        .when(v > 0, size + 1).when(v < 0, -size - 1).when(v == 0, F.lit(0))
    )


def grouped_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], per_octave: int = PER_OCTAVE) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size; lazy, the input is read once.

    ``wanted`` maps each output column to (value column, level). NULL values are skipped, NaN is the largest, keys may be
    NULL. Every group of ``df`` has a row; without a value its quantiles are NULL. Without keys there is one row.

    A selection by digits: values are counted by (group, value), so a group of any size is spread over all tasks and
    exchanged as counts; those are summed by bucket (a few thousand for each group), which tells the buckets that hold the
    wanted ranks; only the values of these are put in order. Both uses of the counts share one exchange.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    counted = df.select(*keys, F.explode(values).alias("_x")).groupBy(*keys, F.col("_x._c").alias("_c"), F.col("_x._v").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    # NULLs have a bucket of their own: a filter on them would reach the input of one use of the counts only
    counted = counted.withColumn("_b", F.coalesce(_bucket(F.col("_v"), per_octave), F.lit(_NULLS)))

    group = Window.partitionBy(*keys, "_c")
    buckets = counted.groupBy(*keys, "_c", "_b").agg(F.sum("_m").alias("_m"))
    known = F.when(F.col("_b") > _NULLS, F.col("_m")).otherwise(F.lit(0))
    buckets = buckets.withColumns({"_end": F.sum(known).over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum(known).over(group)})
    ranks = []
    for name, (column, level) in wanted.items():
        place = (F.col("_n") - 1) * F.lit(level)
        ranks += [
            F.struct(F.lit(columns.index(column)).alias("of"), F.lit(name).alias("name"), F.lit(side).alias("side"), rank(place).cast("long").alias("rank"), (place - F.floor(place)).alias("share"))
            for side, rank in enumerate((F.floor, F.ceil))
        ]
    start = F.col("_end") - F.col("_m")
    within = lambda r: (r["of"] == F.col("_c")) & (r["rank"] >= start) & (r["rank"] < F.col("_end"))
    asked = buckets.withColumn("_picks", F.filter(F.array(*ranks), within)).filter((F.size("_picks") > 0) & (F.col("_n") > 0))
    other = [F.col(k).alias(f"_r_{k}") for k in keys]
    asked = asked.select(*other, F.col("_c").alias("_rc"), F.col("_b").alias("_rb"), start.alias("_base"), "_picks")
    match = (F.col("_c") == F.col("_rc")) & (F.col("_b") == F.col("_rb"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    in_order = Window.partitionBy(*keys, "_c", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(asked, match).withColumn("_end", F.col("_base") + F.sum("_m").over(in_order))
    hit = placed.select(*keys, "_v", F.explode(F.filter("_picks", lambda r: (r["rank"] >= F.col("_end") - F.col("_m")) & (r["rank"] < F.col("_end")))).alias("_p"))
    found = hit.select(*keys, "_v", "_p.name", "_p.side", "_p.share")
    every = buckets.filter("_n = 0").select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (("_v", "double"), ("name", "string"), ("side", "int"), ("share", "double"))])

    def quantile(name: str) -> Column:
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_v"))) for side in (0, 1))
        share = F.max(F.when(F.col("name") == name, F.col("share")))
        return F.when(low == high, low).otherwise(low + share * (high - low)).alias(name)

    return found.unionByName(every).groupBy(*keys).agg(*[quantile(name) for name in wanted])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two per-group results on possibly NULL keys (grouping-set levels leave NULLs)."""
    if not keys:
        return left.join(right, F.lit(True), how)
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, match, how).drop(*[f"_r_{k}" for k in keys])
