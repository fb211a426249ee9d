"""Hash families.

``portable``: the first 60 bits of an MD5, then per register a splitmix64 finaliser. Plain arithmetic, so the JVM,
numpy and other SQL engines agree bit for bit. ``xx``: Spark's own xxhash64, the fastest. ``murmur3``: the low half of
MurmurHash3 x64-128 in numpy, with the seed derivation of the library that this engine is a counterpart of.

Indices of the mixer are split into ranges that never meet: ``[0, m)`` exponentials, ``[m, 2m)`` permutations, then
bucket, the bucket's exponential, and the rank of a HyperLogLog.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M64 = (1 << 64) - 1


def signed(x: int) -> int:
    x &= _M64
    return x - (1 << 64) if x >> 63 else x


_resolving = threading.RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """64-bit arithmetic wraps in expressions that are resolved inside; they keep that when they run later.

    One thread at a time: the setting is the session's.
    """
    with _resolving:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def element_hash(x: Column, seed: int, family: str = "portable") -> Column:
    """The hash of an element, once per element; the seed is part of what is hashed."""
    text = x.cast("string")
    if family == "xx":
        return F.xxhash64(F.lit(signed(seed)), text)
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15), 16, 10).cast("long")


def mixed(h: Column, index: Column) -> Column:
    """64 bits for one register of an element; use it inside ``wrapping``."""
    z = h + (index.cast("long") + 1) * F.lit(signed(GOLDEN))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(signed(MIX1))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(signed(MIX2))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def unit(z: Column) -> Column:
    """(0, 1], in steps of 2**-52."""
    return (F.shiftrightunsigned(z, 12) + 1).cast("double") / F.lit(float(1 << 52))


def mixed_np(h: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``mixed`` in numpy: rows of ``h`` by columns of ``index``."""
    z = h[:, None] + (index.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def unit_np(z: np.ndarray) -> np.ndarray:
    return ((z >> np.uint64(12)) + np.uint64(1)).astype(np.float64) / float(1 << 52)


def splitmix64(x: int) -> int:
    """The generator's step and finaliser."""
    z = (x + GOLDEN) & _M64
    z = ((z ^ (z >> 30)) * MIX1) & _M64
    z = ((z ^ (z >> 27)) * MIX2) & _M64
    return z ^ (z >> 31)


def derived_seeds(master: int, n: int) -> np.ndarray:
    """32-bit seeds of n registers."""
    return np.array([splitmix64(splitmix64(master) ^ splitmix64(i)) & 0xFFFFFFFF for i in range(n)], np.uint64)


_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return k ^ (k >> np.uint64(33))


def murmur64(data: bytes, seeds: np.ndarray) -> np.ndarray:
    """The low 64 bits of MurmurHash3 x64-128 of ``data``, for all seeds at once."""
    h1, h2 = seeds.astype(np.uint64), seeds.astype(np.uint64)
    n = len(data)
    whole = n // 16
    with np.errstate(over="ignore"):
        for k1, k2 in np.frombuffer(data[: whole * 16], "<u8").reshape(-1, 2):
            h1 = h1 ^ (_rotl(k1 * _C1, 31) * _C2)
            h1 = (_rotl(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 = h2 ^ (_rotl(k2 * _C2, 33) * _C1)
            h2 = (_rotl(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        tail = data[whole * 16 :]
        if len(tail) > 8:
            k2 = np.uint64(int.from_bytes(tail[8:], "little"))
            h2 = h2 ^ (_rotl(k2 * _C2, 33) * _C1)
        if tail:
            k1 = np.uint64(int.from_bytes(tail[:8], "little"))
            h1 = h1 ^ (_rotl(k1 * _C1, 31) * _C2)
        h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix(h1), _fmix(h2)
        return h1 + h2


def to_unit_interval(h: np.ndarray) -> np.ndarray:
    """(h + 1) / (2**64 - 1); the top value wraps to 0, which stands for the least positive double here."""
    with np.errstate(over="ignore"):
        u = (h + np.uint64(1)).astype(np.float64) / float(_M64)
    return np.where(u == 0, np.finfo(np.float64).tiny, u)
