"""Weighted streams of known cardinality and similarity, and error measures."""

from __future__ import annotations

import math
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISTRIBUTIONS = ("uniform", "exponential", "pareto", "geometric", "monotonic", "zipf", "constant")


class Placement(Enum):
    """Where shared elements stand in a stream."""

    FIRST = "first"
    LAST = "last"
    RANDOM = "random"


def make_seeds(m: int, seed: int) -> list[int]:
    """``m`` integers from 1 to 2**31 - 1."""
    return np.random.default_rng(seed).integers(1, 1 << 31, m).tolist()


def _uniform(k: Column, seed: int) -> Column:
    """(0, 1) as a pure function of a row's number: the same however the rows are dealt out."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), k), 12) + 0.5) / float(1 << 52)


def raw_weight(distribution: str, k: Column, n: int, seed: int) -> Column:
    u = _uniform(k, seed)
    made = {
        "uniform": lambda: 0.5 + u,
        "exponential": lambda: -F.ln(u),
        "pareto": lambda: F.pow(u, F.lit(-1 / 0.2)),
        "geometric": lambda: F.exp(-F.lit(12.0) * k / max(1, n - 1)),
        "monotonic": lambda: (k + 1).cast("double"),
        "zipf": lambda: 1.0 / (k + 1),
        "constant": lambda: F.lit(1.0),
    }
    if distribution not in made:
        raise ValueError(f"no distribution is called {distribution!r}; there are {', '.join(DISTRIBUTIONS)}")
    return made[distribution]()


def _element(k: Column, seed: int, side: str = "") -> Column:
    return F.concat(F.lit(f"x{side}"), F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.lit(side)), 1).cast("string"), F.lit("_"), k.cast("string"))


def elements_stream(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``pos, x``: n different elements."""
    return spark.range(n).select(F.col("id").alias("pos"), _element(F.col("id"), seed).alias("x"))


def weighted_stream(spark: SparkSession, n: int, total: float, distribution: str = "uniform", seed: int = 0) -> DataFrame:
    """``pos, x, w``: n different elements whose weights add up to ``total``."""
    rows = spark.range(n).select(F.col("id").alias("pos"), _element(F.col("id"), seed).alias("x"), raw_weight(distribution, F.col("id"), n, seed).alias("raw"))
    whole = rows.agg(F.sum("raw").alias("all"))
    return rows.crossJoin(F.broadcast(whole)).select("pos", "x", (F.col("raw") / F.col("all") * total).alias("w"))


def jaccard_streams(spark: SparkSession, n: int, total: float, similarity: float, distribution: str = "uniform", shared: int | None = None, placement: Placement = Placement.RANDOM, seed: int = 0) -> DataFrame:
    """``side, pos, x, w``: two streams of n elements and weight ``total`` each, with that weighted Jaccard similarity.

    Shared elements have one weight on both sides, ``2 J total / (1 + J)`` in sum; ``shared`` of n are shared.
    """
    if not 0 <= similarity <= 1:
        raise ValueError("the similarity is from 0 to 1")
    k = round(n * 2 * similarity / (1 + similarity)) if shared is None else shared
    k = n if similarity == 1 else 0 if similarity == 0 else min(max(1, k), n - 1)
    common = 2 * similarity * total / (1 + similarity)
    rows = spark.range(n).select("id", raw_weight(distribution, F.col("id"), n, seed).alias("raw"), (F.col("id") < k).alias("both"))
    sums = {r["both"]: r["s"] for r in rows.groupBy("both").agg(F.sum("raw").alias("s")).collect()}
    w = F.col("raw") * F.when(F.col("both"), common / sums.get(True, 1.0)).otherwise((total - common) / sums.get(False, 1.0))
    out = None
    for side in ("a", "b"):
        x = F.when(F.col("both"), _element(F.col("id"), seed)).otherwise(_element(F.col("id"), seed, side))
        pos = {Placement.FIRST: F.col("id"), Placement.LAST: F.pmod(F.col("id") - k, F.lit(n)), Placement.RANDOM: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(side), "id"), 1)}[placement]
        some = rows.select(F.lit(side).alias("side"), pos.alias("pos"), x.alias("x"), w.alias("w"))
        out = some if out is None else out.unionByName(some)
    return out


def relative_error(estimate: Column, truth: Column) -> Column:
    return F.abs(estimate - truth) / truth


def safe_relative_error(estimate: Column, truth: Column, most: float = 10.0) -> Column:
    """The relative error, ``most`` where the estimate is not finite or not positive."""
    bad = estimate.isNull() | F.isnan(estimate) | (F.abs(estimate) == math.inf) | (estimate <= 0)
    return F.when(bad, most).otherwise(F.least(relative_error(estimate, truth), F.lit(most)))


def rse(error: Column) -> Column:
    """Root of the mean square of errors, without NaN."""
    e = F.when(~F.isnan(error), error)
    return F.sqrt(F.avg(e * e))


def jaccard_variance(similarity: float, m: int) -> float:
    return similarity * (1 - similarity) / m


def experiment(spark: SparkSession, make, sizes: list[int], n: int, total: float, repetitions: int, distribution: str = "uniform", seed: int = 0, **options) -> DataFrame:
    """``m, rse``: the relative standard error over repetitions, each with elements of its own, in one job per size."""
    from ..operators.estimate import estimate
    from ..operators.registers import build

    rows = weighted_stream(spark, n, total, distribution, seed)
    reps = spark.range(repetitions).select(F.col("id").alias("rep"))
    many = rows.crossJoin(F.broadcast(reps)).withColumn("x", F.concat_ws("/", "rep", "x"))
    out = None
    for m in sizes:
        spec = make(m)
        got = estimate(build(many, spec, ["rep"], **options), spec, ["rep"])
        one = got.agg(rse(relative_error(F.col("estimate"), F.lit(total))).alias("rse")).select(F.lit(m).alias("m"), "rse")
        out = one if out is None else out.unionByName(one)
    return out
