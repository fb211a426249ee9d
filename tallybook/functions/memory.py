"""How many bytes a sketch takes, by component; and bit-packed registers."""

from __future__ import annotations

import math

import numpy as np

from ..spec import MemoryFlag, SketchSpec

_ALL = MemoryFlag.REGISTERS | MemoryFlag.ALL_WRITE_NO_REGISTERS | MemoryFlag.FISHER_YATES | MemoryFlag.SEEDS


def resolve(flags: MemoryFlag) -> MemoryFlag:
    """With TOTAL the other bits are what is left out."""
    return _ALL & ~(flags & ~MemoryFlag.TOTAL) if flags & MemoryFlag.TOTAL else flags


def words(size: int, bits: int) -> int:
    return 8 * -(-size * bits // 64)


def compact_vector_bytes(size: int, bits: int) -> int:
    return (size * bits + 7) // 8


def register_bits(spec: SketchSpec) -> int:
    """Bits of a register when it is packed."""
    if spec.amount_bits is not None:
        return spec.amount_bits
    if spec.exp_bits is not None:
        return spec.exp_bits + spec.mant_bits
    return {"double": 64, "float": 32, "int": 8}[spec.traits.value]


def memory_usage(spec: SketchSpec, flags: MemoryFlag = MemoryFlag.TOTAL) -> int:
    """Bytes of one sketch. The scalars are its size, parameters and running values, eight bytes each at most."""
    flags, m = resolve(flags), spec.m
    rank = max(1, math.ceil(math.log2(m)))
    total = 0
    if flags & MemoryFlag.REGISTERS:
        packed = spec.amount_bits is not None or spec.exp_bits is not None
        total += words(m, register_bits(spec)) if packed else m * register_bits(spec) // 8
        if spec.kind.endswith("Dyn"):
            total += words(1 << spec.amount_bits, max(1, math.ceil(math.log2(m))))
    if flags & MemoryFlag.ALL_WRITE_NO_REGISTERS:
        total += 8
        total += 1 + 8 * ((spec.logarithm_base or spec.v_max) is not None) if spec.amount_bits is not None else 0
        total += 2 if spec.exp_bits is not None else 0
        total += 8 if spec.traits.family in ("ordered", "sequential") else 0
        total += 4 if spec.kind.endswith("Shifted") and not spec.kind.endswith("NoShifted") else 0
        total += 4 if spec.kind.endswith("Dyn") else 0
    if spec.traits.family == "ordered":
        if flags & MemoryFlag.FISHER_YATES_PERM_INIT:
            total += words(m, rank)
        if flags & MemoryFlag.FISHER_YATES_NON_PERM_INIT:
            total += words(m, rank) + 16
    if flags & MemoryFlag.SEEDS:
        total += 8
    return total


def pack(values: np.ndarray, bits: int) -> bytes:
    """Unsigned values of ``bits`` bits each, one after another."""
    v = np.asarray(values, np.uint64)
    if bits < 64 and (v >> np.uint64(bits)).any():
        raise ValueError(f"a value takes more than {bits} bits")
    return np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def float_codes(values: np.ndarray, exp_bits: int, mant_bits: int) -> np.ndarray:
    """Values of a custom float as its bits, exponent first. The greatest value reads as an empty register; so does infinity."""
    v = np.asarray(values, np.float64)
    most = (1 << (exp_bits + mant_bits)) - 1
    mantissa, exponent = np.frexp(np.where(np.isfinite(v), v, 1.0))
    place = exponent.astype(np.int64) - 1 + (1 << (exp_bits - 1)) - 1
    code = (place << mant_bits) | np.floor((2 * mantissa - 1) * float(1 << mant_bits)).astype(np.int64)
    return np.where(np.isfinite(v), code, most)


def code_values(codes: np.ndarray, exp_bits: int, mant_bits: int) -> np.ndarray:
    """The values of ``float_codes``; infinity for the greatest."""
    codes = np.asarray(codes, np.int64)
    exponent = (codes >> mant_bits) - ((1 << (exp_bits - 1)) - 1)
    fraction = (codes & ((1 << mant_bits) - 1)) / float(1 << mant_bits)
    with np.errstate(over="ignore"):
        return np.where(codes == (1 << (exp_bits + mant_bits)) - 1, np.inf, np.ldexp(1 + fraction, exponent.astype(np.int32)))


def unpack(data: bytes, bits: int, size: int) -> np.ndarray:
    ones = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: size * bits].reshape(size, bits)
    return (ones.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
