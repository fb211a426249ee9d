"""From registers to estimates, one row per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SketchSpec
from .keys import by_inner_names, names

NEWTON_TOLERANCE, NEWTON_MOST = 1e-6, 100


def reconstructed(spec: SketchSpec, r: Column) -> Column:
    """The value that a register stands for: of LogExp grids the exponential, of logarithmic sketches base**-r."""
    if spec.kind.startswith("LogExp"):
        return F.lit(spec.scale) * F.exp(r * F.lit(spec.log_step))
    if spec.kind.startswith("QSketch") or spec.kind == "HyperLogLog":
        return F.pow(F.lit(2.0), -r.cast("double"))
    if spec.traits.value == "int":
        return F.exp(-r * F.lit(spec.log_step))
    return r.cast("double")


def hll_alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


@by_inner_names
def estimate(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, estimate``: the weighted cardinality. Without any register 0 (only possible without keys).

    Sketches whose estimator divides by a sum give 0 for one register.
    """
    keys, m = names(keys), spec.m
    if spec.traits.family == "sequential":
        raise ValueError(f"{spec.kind} is estimated while its rows are read: use ordered.build_ordered")
    if spec.kind in ("QSketch", "kQSketch", "kQSketchShifted"):
        return newton(registers, spec, keys).select(*keys, "estimate")
    value = reconstructed(spec, F.col("r"))
    if spec.kind == "WeightedMinHash":
        value = 1 - F.col("r")
    got = registers.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    s, n = F.col("_s"), F.col("_n")
    if spec.kind.startswith("WeightedHyperLogLog"):
        part = F.when(n == 1, F.lit(0.5)).otherwise((n - 1) / n)
        out = F.when(n == 0, 0.0).when(s <= 0, F.lit(math.inf)).otherwise(part * n * m / s)
    elif spec.kind == "HyperLogLog":
        zeros = F.lit(m) - n
        raw = F.lit(hll_alpha(m) * m * m) / (F.coalesce(s, F.lit(0.0)) + zeros)
        out = F.when(n == 0, 0.0).when((raw <= 2.5 * m) & (zeros > 0), m * F.ln(F.lit(float(m)) / zeros)).otherwise(raw)
    else:
        out = F.when(n == 0, 0.0).when(s <= 0, F.lit(math.inf)).otherwise(F.lit(float(m - 1)) / s)
    return got.select(*keys, out.alias("estimate"))


def estimate_corrected(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``kQSketchRounding``: the estimate times ``2 sinh(ln k / 2) / ln k``, which undoes the bias of rounding."""
    if spec.kind != "kQSketchRounding":
        raise ValueError(f"{spec.kind} has no corrected estimate")
    factor = 2 * math.sinh(spec.log_step / 2) / spec.log_step
    return estimate(registers, spec, keys).withColumn("estimate", F.col("estimate") * F.lit(factor))


@by_inner_names
def estimate_direct(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """The closed form of the sketches with a logarithmic base.

    That of a kQSketchRoundedDyn is its running value, which the table that ``ordered.dyn`` gives holds.
    """
    keys = names(keys)
    if not spec.has_newton:
        raise ValueError(f"{spec.kind} has no direct estimate")
    if spec.kind == "kQSketchRoundedDyn":
        return _running(registers, keys)
    if spec.kind == "kQSketchRounding":
        return estimate(registers, spec, keys)
    top = F.lit((spec.logarithm_base - 1) * spec.m / spec.log_step)
    got = registers.groupBy(*keys).agg(F.sum(reconstructed(spec, F.col("r"))).alias("_s"))
    return got.select(*keys, F.when(F.col("_s").isNull(), 0.0).otherwise(top / F.col("_s")).alias("estimate"))


def _running(state: DataFrame, keys: list[str]) -> DataFrame:
    if "estimate" not in state.columns:
        raise ValueError("a kQSketchRoundedDyn is estimated from its running value: give the table that ordered.dyn makes")
    return state.select(*keys, "estimate")


def step_q(w: float, r: np.ndarray, n: np.ndarray) -> float:
    """f / f' of the QSketch likelihood at ``w``; ``n`` registers hold ``r``."""
    x = np.exp2(-r - 1.0)
    with np.errstate(over="ignore"):
        e = np.expm1(w * x)
        f = np.sum(n * x * np.where(np.isinf(e), -1.0, (1.0 - e) / e))
        d = -np.sum(n * x * x * np.where(e > 1e150, 0.0, (e + 1.0) / (e * e)))
    return float(f / d)


def step_kq(w: float, r: np.ndarray, n: np.ndarray, log_base: float) -> float:
    """f / f' of the base-k likelihood at ``w``."""
    c = np.exp(-r * log_base)
    low = c / math.exp(log_base)
    # with y = w (c - low): (c a - low b) / (b - a) = (c - low) / (e**y - 1) - low
    span = c - low
    with np.errstate(over="ignore"):
        e = np.expm1(w * span)
        f = np.sum(n * (span / e - low))
        d = -np.sum(n * np.where(e > 1e150, 0.0, span * span * (e + 1.0) / (e * e)))
    return float(f / d)


def solve(spec: SketchSpec, r: np.ndarray, n: np.ndarray, start: str) -> tuple[float, int]:
    """Newton's method from the direct form (``warm``), the least register (``cold``) or ``(m-1)/sum`` (``default``)."""
    r, n = np.asarray(r, np.float64), np.asarray(n, np.float64)
    if not len(r):
        return 0.0, 0
    base = math.log(2.0) if spec.kind == "QSketch" else spec.log_step
    total = float(np.sum(n * np.exp(-r * base)))
    if start == "warm":
        w = (spec.logarithm_base - 1) * spec.m / (spec.log_step * total)
    elif start == "cold":
        w = math.exp(base * float(r.min()))
    else:
        w = max(spec.m - 1, 0.5) / total
    for turn in range(1, NEWTON_MOST + 1):
        step = step_q(w, r, n) if spec.kind == "QSketch" else step_kq(w, r, n, base)
        following = w - step
        if following <= 0:  # an overshoot: the root is positive
            following = w / 2
        if abs(following - w) <= NEWTON_TOLERANCE * 1e-3 * abs(following):
            return following, turn
        w = following
    raise ArithmeticError(f"Newton's method did not settle in {NEWTON_MOST} turns")


@by_inner_names
def newton(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = (), start: str = "default") -> DataFrame:
    """``keys, estimate, iterations``. Runs on the histogram of a key's registers, at most ``m`` rows per key."""
    keys = names(keys)
    if spec.kind not in ("QSketch", "kQSketch", "kQSketchShifted"):
        if not spec.has_newton:
            raise ValueError(f"{spec.kind} has no Newton estimate")
        if spec.kind == "kQSketchRoundedDyn":
            return _running(registers, keys).withColumn("iterations", F.lit(0))
        return estimate(registers, spec, keys).withColumn("iterations", F.lit(0))
    if start not in ("default", "warm", "cold") or (start == "warm" and spec.kind == "QSketch"):
        raise ValueError("start is default, cold, or warm where there is a direct estimate")

    @F.pandas_udf("estimate double, iterations int")
    def run(r: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([solve(spec, a, b, start) for a, b in zip(r, n)], columns=["estimate", "iterations"])

    counts = registers.groupBy(*keys, "r").count()
    rows = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "count"))).alias("_h"))
    got = rows.withColumn("_e", run(F.col("_h.r"), F.col("_h.count")))
    return got.select(*keys, "_e.estimate", "_e.iterations")
