"""Connected components of a set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import Stages


def components(links: DataFrame, stages: Stages, name: str) -> DataFrame:
    """node and its label, the smallest node it can reach, for the nodes of ``links`` (columns a, b).

    Large-star and small-star by turns: each node's neighbours are hung below the smallest of them until nothing changes,
    which takes a number of turns logarithmic in the longest path. The minima are found by aggregations with map-side
    combine and joined back, so a node with very many neighbours needs no task of its own.
    """
    pairs = stages.put(f"{name}-0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last, turn = None, 0
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.filter("u <> v").distinct()
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        turn += 1
        pairs = stages.put(f"{name}-{turn}", small.select("e.u", "e.v").filter("u <> v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
