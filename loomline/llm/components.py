"""Connected components by alternating large and small stars, with stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component): the smallest node that each node reaches; nodes without edges are absent.

    Every round hangs neighbours on the smallest one in sight; minima are map-side partial aggregates, so a node with very many neighbours is a row a task. Rounds grow with the logarithm of the longest path.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e)
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state, before = _state(e), state
        if state == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots))
