import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions.hashing import derived_seeds, element_hash, mixed, mixed_np, murmur64, splitmix64, to_unit_interval, unit, unit_np, wrapping


def test_murmur_known_answers():
    for text, want in [(b"", 0), (b"hello", 0xCBD8A7B341BD9B02), (b"The quick brown fox jumps over the lazy dog", 0xE34BBC7BBC071B6C)]:
        assert int(murmur64(text, np.array([0], np.uint64))[0]) == want


def test_derived_seeds():
    assert derived_seeds(42, 4).tolist() == [2124684621, 2115641874, 2110732380, 2487635798]
    assert len(set(derived_seeds(7, 1000).tolist())) == 1000


@given(st.integers(0, (1 << 64) - 1))
def test_splitmix_is_a_64_bit_number(x):
    assert 0 <= splitmix64(x) < 1 << 64


def test_spark_and_numpy_mix_alike(spark):
    with wrapping(spark):
        rows = spark.range(200).select(element_hash(F.col("id"), 42).alias("h"), (F.col("id") * 7).alias("i"))
        rows = rows.select("h", "i", mixed(F.col("h"), F.col("i")).alias("z"), unit(mixed(F.col("h"), F.col("i"))).alias("u"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for r in rows.collect():  # wraps although ANSI is on again
        z = mixed_np(np.array([r.h], np.uint64), np.array([r.i]))
        assert int(z[0, 0]) == r.z & (1 << 64) - 1 and unit_np(z)[0, 0] == r.u and 0 < r.u <= 1


def test_unit_interval_ends():
    u = to_unit_interval(np.array([0, (1 << 64) - 1, 1 << 63], np.uint64))
    assert (u > 0).all() and (u <= 1).all() and u[2] == pytest.approx(0.5)
