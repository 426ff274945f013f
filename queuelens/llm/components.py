"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import cut, forget


def _checked(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the least id that it reaches.

    Each round makes every id's edges a star around the least id in reach, until nothing changes; each round's table
    replaces the last one's. Least neighbours are pre-aggregated. An id that is the least of its neighbours already, as
    the centre of a large star is, keeps its edges without a join.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = _checked(stars)
    while last[0]:
        below = stars.groupBy("a").agg(F.min("b").alias("m"))
        moved = stars.join(below.withColumnsRenamed({"a": "b", "m": "low"}), "b", "left")
        large = moved.select("a", F.coalesce("low", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = _checked(new)
        forget(stars)
        stars = new
        if now == last:
            break
        last = now
    roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
