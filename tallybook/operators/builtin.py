"""The fast path for unweighted counts: Spark's own HyperLogLog and theta sketches, one binary per key.

They run inside the JVM's aggregation without registers as rows, so they are the choice where only distinct counts, and
for theta set operations, are asked for. Their state is another format than that of ``build``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import column, inner, inward, names, outward

_AGG = {"hll": (F.hll_sketch_agg, F.hll_union_agg, F.hll_sketch_estimate), "theta": (F.theta_sketch_agg, F.theta_union_agg, F.theta_sketch_estimate)}


def _of(kind: str):
    if kind not in _AGG:
        raise ValueError("kind is hll or theta")
    return _AGG[kind]


def build_builtin(df: DataFrame, keys: str | Sequence[str] = (), x: str = "x", kind: str = "hll", log_size: int = 12) -> DataFrame:
    """``keys, sketch``: the distinct elements of each key. Null elements are ignored; a null key is a key like any other."""
    keys = names(keys)
    rows = df.select(*[column(df, k).alias(n) for k, n in zip(keys, inner(keys))], column(df, x).cast("string").alias("_x"))
    return outward(rows.groupBy(*inner(keys)).agg(_of(kind)[0]("_x", log_size).alias("sketch")), keys)


def merge_builtin(sketches: DataFrame, keys: str | Sequence[str] = (), kind: str = "hll") -> DataFrame:
    """Coarser groups from finer ones, or the union of tables of sketches that were put one below another."""
    keys = names(keys)
    return outward(inward(sketches, keys).groupBy(*inner(keys)).agg(_of(kind)[1]("sketch").alias("sketch")), keys)


def estimate_builtin(sketches: DataFrame, keys: str | Sequence[str] = (), kind: str = "hll") -> DataFrame:
    """``keys, estimate``: how many distinct elements."""
    keys = names(keys)
    return outward(inward(sketches, keys).select(*inner(keys), _of(kind)[2]("sketch").alias("estimate")), keys)


def set_sizes_builtin(a: DataFrame, b: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, size_union, size_intersection, size_difference`` of theta sketches, for keys that both sides have; null keys meet."""
    keys = names(keys)
    inside = inner(keys)
    left, right = (inward(t, keys).select(*[F.col(k).alias(f"{k}{s}") for k in inside], F.col("sketch").alias(f"sketch_{s}")) for t, s in ((a, "a"), (b, "b")))
    same = F.lit(True)
    for k in inside:
        same = same & F.col(f"{k}a").eqNullSafe(F.col(f"{k}b"))
    got = left.join(right, same)
    of = lambda verb: F.theta_sketch_estimate(verb("sketch_a", "sketch_b"))
    return outward(got.select(*[F.col(f"{k}a").alias(k) for k in inside], of(F.theta_union).alias("size_union"), of(F.theta_intersection).alias("size_intersection"), of(F.theta_difference).alias("size_difference")), keys)
