"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewire.llm.common import saved


def _mins(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of non-null longs -> ``(node, component)``, component = smallest node reachable.

    Each step is an aggregation (map-side minima) and an equi-join, saved in the shared folder; the number of
    steps grows with the logarithm of the longest path.  Self loops and repeated edges are allowed.  An empty
    table gives an empty result.  A hub's minima are combined before the shuffle, its edges are joined by
    a skew-joinable equi-join.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = saved(edges.filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_mins(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = saved(large)
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        mins = low.groupBy("u").agg(F.min("v").alias("m"))
        star = low.join(mins, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = saved(star.select("x.u", "x.v").filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    labels = e.groupBy("u").agg(F.min("v").alias("component"))
    return (nodes.join(labels.withColumnRenamed("u", "node"), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
