import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook import QuantizationMode as M
from tallybook.functions.quantize import custom_float_max, custom_float_min, quantize, quantize_np

FORMATS = [(2, 1), (3, 0), (3, 2), (3, 4), (4, 3), (5, 10), (8, 23)]
VALUES = [1e-30, 1e-20, 1e-3, 0.0, 0.24, 0.25, 0.26, 0.5, 1.0, 1.5, 1.999, 3.7, 7.0, 100.0, 1e20, 1e30, -1.5, math.inf, -math.inf, math.nan]


@pytest.mark.parametrize("exp_bits, mant_bits", FORMATS)
@pytest.mark.parametrize("mode", list(M))
def test_ends_grid_and_order(exp_bits, mant_bits, mode):
    low, high = custom_float_min(exp_bits, mant_bits, mode), custom_float_max(exp_bits, mant_bits, mode)
    assert quantize_np(np.array([1e-300, 0.0, -5.0]), exp_bits, mant_bits, mode).tolist() == [low] * 3
    assert quantize_np(np.array([1e300, math.nan, math.inf]), exp_bits, mant_bits, mode).tolist() == [high] * 3
    v = np.exp(np.random.default_rng(1).uniform(np.log(low), np.log(min(high, 1e200)), 2000))
    q = quantize_np(v, exp_bits, mant_bits, mode)
    assert (q <= v * (1 + 1e-12)).all() and (q >= low).all()
    assert (np.diff(q[np.argsort(v)]) >= 0).all()
    again = quantize_np(q, exp_bits, mant_bits, mode)
    if mode in (M.ALL_NORMAL, M.WITH_SUBNORMALS):
        assert (again == q).all()
        part, _ = np.frexp(q)
        normal = q >= 2.0 ** (1 - ((1 << (exp_bits - 1)) - 1))
        assert ((part[normal] * 2 * 2**mant_bits) % 1 == 0).all()
        assert (v[normal] / q[normal] < 1 + 2.0**-mant_bits + 1e-12).all()


@pytest.mark.parametrize("exp_bits, mant_bits", FORMATS)
@pytest.mark.parametrize("mode", list(M))
@pytest.mark.parametrize("sign", [0, 1])
def test_column_form(spark, exp_bits, mant_bits, mode, sign):
    rng = np.random.default_rng(2)
    values = [*VALUES, *np.exp(rng.uniform(-20, 20, 40)).tolist(), *[2.0**k for k in range(-20, 20)]]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(quantize(F.col("v"), exp_bits, mant_bits, mode, sign)).collect()]
    want = quantize_np(np.array(values), exp_bits, mant_bits, mode, sign)
    assert got == pytest.approx(want.tolist(), rel=1e-12)


def test_bad_formats():
    for bad in [(0, 1, 0), (3, -1, 0), (3, 1, 2)]:
        with pytest.raises(ValueError):
            quantize_np(np.array([1.0]), bad[0], bad[1], M.LINEAR, bad[2])
