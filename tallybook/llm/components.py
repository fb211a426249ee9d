"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each node, or the node itself."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.where("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links of long ids to ``(node, root)``: the least id that each linked node reaches.

    Ids without links do not appear, nor do the roots. Loops, repeated links and empty input are fine;
    null ends are dropped. What meets at a component's root are its links, 16 bytes each, with one row: least neighbours are
    partial aggregates, and a root with so many links that its partition is large is split by AQE's skew join. The number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 24))).first()
        if tuple(now) == seen or now[0] == 0:
            break
        seen = tuple(now)
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
