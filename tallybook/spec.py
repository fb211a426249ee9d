"""What a sketch is: its kind, parameters and capabilities."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from enum import Enum, IntFlag

import numpy as np


class RngEngine(Enum):
    """Kept in a spec for callers that set it; permutations here come from hashes, so it changes no result."""

    PCG64 = "PCG64"
    MT19937_64 = "MT19937_64"
    XOSHIRO128PP = "XOSHIRO128PP"
    XOSHIRO256PP = "XOSHIRO256PP"


class QuantizationMode(Enum):
    ALL_NORMAL = "ALL_NORMAL"
    WITH_SUBNORMALS = "WITH_SUBNORMALS"
    LINEAR = "LINEAR"
    LOGARITHMIC = "LOGARITHMIC"


class MemoryFlag(IntFlag):
    """Components of a sketch's size. With TOTAL, the other bits are left out of the sum."""

    NOTHING = 0
    REGISTERS = 1
    ALL_WRITE_NO_REGISTERS = 2
    FISHER_YATES_PERM_INIT = 4
    FISHER_YATES_NON_PERM_INIT = 8
    SEEDS = 16
    TOTAL = 32
    ALL_WRITE = 3
    FISHER_YATES = 12


@dataclass(frozen=True)
class Kind:
    """``family``: independent (a value per element and register), ordered (ascending order statistics and a
    permutation), bucket (one register per element) or sequential (order matters). ``least``: MIN or MAX."""

    name: str
    family: str
    least: bool
    value: str  # double, float, int
    weighted: bool = True
    mergeable: bool = True
    jaccard: bool = False
    newton: bool = False
    needs: tuple[str, ...] = ()


_KINDS = [
    Kind("ExpSketch", "independent", True, "double", jaccard=True),
    Kind("ExpSketchFloat32", "independent", True, "float", jaccard=True),
    Kind("FastExpSketch", "ordered", True, "double", jaccard=True),
    Kind("FastExpSketchFloat32", "ordered", True, "float", jaccard=True),
    Kind("FastGMExpSketch", "ordered", True, "double", jaccard=True),
    Kind("FastExpSketchCustomFloat", "ordered", True, "double", jaccard=True, needs=("exp_bits", "mant_bits")),
    Kind("LogExpSketchSlowNoShifted", "independent", True, "int", jaccard=True, needs=("amount_bits", "v_max")),
    Kind("LogExpSketchFastNoShifted", "ordered", True, "int", jaccard=True, needs=("amount_bits", "v_max")),
    Kind("LogExpSketchSlowShifted", "independent", True, "int", jaccard=True, needs=("amount_bits", "v_max")),
    Kind("LogExpSketchFastShifted", "ordered", True, "int", jaccard=True, needs=("amount_bits", "v_max")),
    Kind("QSketch", "ordered", False, "int", needs=("amount_bits",)),
    Kind("QSketchDyn", "sequential", False, "int", mergeable=False, needs=("amount_bits",)),
    Kind("kQSketch", "ordered", False, "int", newton=True, needs=("amount_bits", "logarithm_base")),
    Kind("kQSketchRounding", "ordered", False, "int", newton=True, needs=("amount_bits", "logarithm_base")),
    Kind("kQSketchRoundedDyn", "sequential", False, "int", mergeable=False, newton=True, needs=("amount_bits", "logarithm_base")),
    Kind("kQSketchShifted", "ordered", False, "int", newton=True, needs=("amount_bits", "logarithm_base")),
    Kind("WeightedMinHash", "independent", False, "double"),
    Kind("WeightedHyperLogLog", "bucket", True, "double"),
    Kind("WeightedHyperLogLogFloat32", "bucket", True, "float"),
    Kind("WeightedHyperLogLogCustomFloat", "bucket", True, "double", needs=("exp_bits", "mant_bits")),
    Kind("MinHash", "independent", True, "double", weighted=False, jaccard=True),
    Kind("MartingaleMinHash", "sequential", True, "double", weighted=False, mergeable=False),
    Kind("HyperLogLog", "bucket", False, "int", weighted=False),
]
KINDS = {k.name: k for k in _KINDS}


@dataclass(frozen=True)
class SketchSpec:
    """All parameters of a sketch. Two sketches are comparable only if their specs are equal."""

    kind: str
    m: int
    seed: int = 42
    amount_bits: int | None = None
    logarithm_base: float | None = None
    v_max: float | None = None
    exp_bits: int | None = None
    mant_bits: int | None = None
    g_seed: int = 42
    rng_engine: RngEngine = RngEngine.XOSHIRO128PP
    hash: str = "portable"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no sketch is called {self.kind!r}; there are {', '.join(KINDS)}")
        if not isinstance(self.m, int) or self.m <= 0:
            raise ValueError("m must be a positive integer")
        if not 0 <= self.seed < 1 << 64:
            raise ValueError("the seed must be an unsigned 64-bit integer")
        if not 0 <= self.g_seed < 1 << 64:
            raise ValueError("g_seed must be an unsigned 64-bit integer")
        for name in self.traits.needs:
            if getattr(self, name) is None:
                raise ValueError(f"{self.kind} needs {name}")
        if self.amount_bits is not None and not 2 <= self.amount_bits <= 31:
            raise ValueError("amount_bits must be 2 at least, and 31 at most")
        if self.v_max is not None and not (self.v_max > 1 and math.isfinite(self.v_max)):
            raise ValueError("v_max must be finite and over 1")
        if self.logarithm_base is not None:
            base = float(np.float32(self.logarithm_base))
            if not (base > 1 and math.isfinite(base)):
                raise ValueError("logarithm_base must be finite and over 1")
            object.__setattr__(self, "logarithm_base", base)
        if self.exp_bits is not None and not 1 <= self.exp_bits <= 11:
            raise ValueError("exp_bits must be from 1 to 11")
        if self.mant_bits is not None and not 0 <= self.mant_bits <= 52:
            raise ValueError("mant_bits must be from 0 to 52")
        if self.hash not in ("portable", "xx", "murmur3"):
            raise ValueError("hash must be portable, xx or murmur3")

    @property
    def traits(self) -> Kind:
        return KINDS[self.kind]

    @property
    def is_weighted(self) -> bool:
        return self.traits.weighted

    @property
    def is_mergeable(self) -> bool:
        return self.traits.mergeable

    @property
    def has_jaccard(self) -> bool:
        return self.traits.jaccard

    @property
    def has_newton(self) -> bool:
        return self.traits.newton

    # ends of integer registers

    @property
    def capacity(self) -> int:
        return (1 << self.amount_bits) - 1

    @property
    def r_min(self) -> int:
        low = -(1 << (self.amount_bits - 1))
        return low if self.kind == "QSketchDyn" else low + 1

    @property
    def r_max(self) -> int:
        return (1 << (self.amount_bits - 1)) - 1

    @property
    def log_step(self) -> float:
        """The logarithm of the grid's ratio: of the base, or of a LogExp grid."""
        if self.logarithm_base is not None:
            return math.log(self.logarithm_base)
        if self.kind == "LogExpSketchSlowShifted":
            return math.log(self.v_max) / self.capacity
        return math.log(self.v_max * self.v_max) / self.capacity

    @property
    def scale(self) -> float:
        """A LogExp grid's value at index 0."""
        return 1.0 if self.kind == "LogExpSketchSlowShifted" else 1.0 / self.v_max

    def with_(self, **changes) -> SketchSpec:
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self) | {"rng_engine": self.rng_engine.value}

    @staticmethod
    def from_dict(x: dict) -> SketchSpec:
        return SketchSpec(**(x | {"rng_engine": RngEngine(x.get("rng_engine", "XOSHIRO128PP"))}))

    def check_same(self, other: SketchSpec) -> None:
        """Raises unless the other spec is equal: registers of unlike hashes or grids must not meet."""
        unlike = [k for k, v in self.to_dict().items() if k != "rng_engine" and v != other.to_dict()[k]]
        if unlike:
            raise ValueError(f"the sketches differ in {', '.join(unlike)}")


def _maker(name: str, *params: str):
    def make(m: int, seed: int = 42, *args, **options) -> SketchSpec:
        if len(args) > len(params):
            raise TypeError(f"{name} takes {', '.join(('m', 'seed', *params))}")
        return SketchSpec(name, m, seed, **dict(zip(params, args)), **options)

    make.__name__ = make.__qualname__ = name
    make.__doc__ = f"A spec of kind {name}: ``{name}({', '.join(('m', 'seed', *params))})``."
    return make


ExpSketch = _maker("ExpSketch")
ExpSketchFloat32 = _maker("ExpSketchFloat32")
FastExpSketch = _maker("FastExpSketch", "rng_engine")
FastExpSketchFloat32 = _maker("FastExpSketchFloat32", "rng_engine")
FastGMExpSketch = _maker("FastGMExpSketch", "rng_engine")
FastExpSketchCustomFloat = _maker("FastExpSketchCustomFloat", "exp_bits", "mant_bits", "rng_engine")
LogExpSketchSlowNoShifted = _maker("LogExpSketchSlowNoShifted", "amount_bits", "v_max")
LogExpSketchFastNoShifted = _maker("LogExpSketchFastNoShifted", "amount_bits", "v_max", "rng_engine")
LogExpSketchSlowShifted = _maker("LogExpSketchSlowShifted", "amount_bits", "v_max")
LogExpSketchFastShifted = _maker("LogExpSketchFastShifted", "amount_bits", "v_max", "rng_engine")
QSketch = _maker("QSketch", "amount_bits", "rng_engine")
QSketchDyn = _maker("QSketchDyn", "amount_bits", "g_seed")
kQSketch = _maker("kQSketch", "amount_bits", "logarithm_base", "rng_engine")
kQSketchRounding = _maker("kQSketchRounding", "amount_bits", "logarithm_base", "rng_engine")
kQSketchRoundedDyn = _maker("kQSketchRoundedDyn", "amount_bits", "logarithm_base", "g_seed")
kQSketchShifted = _maker("kQSketchShifted", "amount_bits", "logarithm_base", "rng_engine")
WeightedMinHash = _maker("WeightedMinHash")
WeightedHyperLogLog = _maker("WeightedHyperLogLog")
WeightedHyperLogLogFloat32 = _maker("WeightedHyperLogLogFloat32")
WeightedHyperLogLogCustomFloat = _maker("WeightedHyperLogLogCustomFloat", "exp_bits", "mant_bits")
MinHash = _maker("MinHash")
MartingaleMinHash = _maker("MartingaleMinHash")
HyperLogLog = _maker("HyperLogLog")
