"""Custom floating-point formats: four ways to map a double to a coarser grid, always downwards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import QuantizationMode as Mode


def _check(exp_bits: int, mant_bits: int, sign_bits: int) -> None:
    if exp_bits < 1 or mant_bits < 0 or sign_bits not in (0, 1):
        raise ValueError("a custom float has 1 exponent bit at least, no negative mantissa and a sign bit of 0 or 1")


def _ldexp(x: float, e: int) -> float:
    try:
        return math.ldexp(x, e)
    except OverflowError:
        return math.inf


def custom_float_max(exp_bits: int, mant_bits: int, mode: Mode = Mode.WITH_SUBNORMALS) -> float:
    """The largest value; with 11 exponent bits it is beyond a double, so infinite."""
    _check(exp_bits, mant_bits, 0)
    return _ldexp(2.0 - 2.0**-mant_bits, (1 << exp_bits) - 1 - ((1 << (exp_bits - 1)) - 1))


def custom_float_min(exp_bits: int, mant_bits: int, mode: Mode = Mode.WITH_SUBNORMALS) -> float:
    """The least positive value."""
    _check(exp_bits, mant_bits, 0)
    bias = (1 << (exp_bits - 1)) - 1
    return 2.0 ** (1 - bias - mant_bits if mode is Mode.WITH_SUBNORMALS else -bias)


def _grid(exp_bits: int, mant_bits: int, mode: Mode) -> tuple[float, float, float]:
    low, high = custom_float_min(exp_bits, mant_bits, mode), custom_float_max(exp_bits, mant_bits, mode)
    levels = float(1 << (exp_bits + mant_bits))
    if levels < 2:
        return low, high, math.nan
    return low, high, (high - low) / (levels - 1) if mode is Mode.LINEAR else math.log(high / low) / (levels - 1) if mode is Mode.LOGARITHMIC else 0.0


def quantize_np(value: np.ndarray, exp_bits: int, mant_bits: int, mode: Mode = Mode.WITH_SUBNORMALS, sign_bits: int = 0) -> np.ndarray:
    """``value`` on the grid. NaN and infinities become the largest value; without a sign bit negatives become the least."""
    _check(exp_bits, mant_bits, sign_bits)
    low, high, step = _grid(exp_bits, mant_bits, mode)
    value = np.asarray(value, np.float64)
    size = np.abs(value)
    with np.errstate(all="ignore"):
        if mode is Mode.LINEAR:
            out = low + np.floor((size - low) / step) * step
        elif mode is Mode.LOGARITHMIC:
            out = low * np.exp(np.floor(np.log(size / low) / step) * step)
        else:
            part, e = np.frexp(size)
            scale = 2.0**mant_bits
            out = np.ldexp(1.0 + np.floor((2 * part - 1) * scale) / scale, e - 1)
            if mode is Mode.WITH_SUBNORMALS:
                bias = (1 << (exp_bits - 1)) - 1
                out = np.where(e - 1 + bias >= 1, out, np.floor(size / low) * low)
    flat = (size <= low) if mode in (Mode.LINEAR, Mode.LOGARITHMIC) else (size < low)
    out = np.where(flat, low, np.where(size >= high, high, out))
    odd = ~np.isfinite(value)
    out = np.where(odd, high, out)
    if sign_bits:
        return np.where((value < 0), -out, out)
    return np.where((value < 0) & ~odd, low, out)


def _floor_log2(v: Column) -> Column:
    """The exponent of a positive double, exact: the logarithm's rounding is put right by comparing with powers."""
    e = F.floor(F.log2(v)).cast("int")
    power = lambda k: F.pow(F.lit(2.0), k)
    return F.when(power(e) > v, e - 1).when(power(e + 1) <= v, e + 1).otherwise(e)


def quantize(value: Column, exp_bits: int, mant_bits: int, mode: Mode = Mode.WITH_SUBNORMALS, sign_bits: int = 0) -> Column:
    """``quantize_np`` as a column expression; null stays null."""
    _check(exp_bits, mant_bits, sign_bits)
    low, high, step = _grid(exp_bits, mant_bits, mode)
    size = F.abs(value)
    inside = F.greatest(F.lit(low), F.least(size, F.lit(high)))  # keeps the branches below finite
    if mode is Mode.LINEAR:
        out = F.lit(low) + F.floor((inside - low) / F.lit(step)) * F.lit(step)
    elif mode is Mode.LOGARITHMIC:
        out = F.lit(low) * F.exp(F.floor(F.log(inside / F.lit(low)) / F.lit(step)) * F.lit(step))
    else:
        e, scale = _floor_log2(inside), float(1 << mant_bits)
        power = F.pow(F.lit(2.0), e)
        out = (F.lit(1.0) + F.floor((inside / power - 1) * F.lit(scale)) / F.lit(scale)) * power
        if mode is Mode.WITH_SUBNORMALS:
            bias = (1 << (exp_bits - 1)) - 1
            out = F.when(e + bias >= 1, out).otherwise(F.floor(inside / F.lit(low)) * F.lit(low))
    flat = (size <= low) if mode in (Mode.LINEAR, Mode.LOGARITHMIC) else (size < low)
    out = F.when(flat, F.lit(low)).when(size >= high, F.lit(high)).otherwise(out)
    odd = F.isnan(value) | (size == math.inf)
    out = F.when(odd, F.lit(high)).otherwise(out)
    if sign_bits:
        out = F.when(~F.isnan(value) & (value < 0), -out).otherwise(out)
    else:
        out = F.when(~odd & (value < 0), F.lit(low)).otherwise(out)
    return F.when(value.isNotNull(), out)
