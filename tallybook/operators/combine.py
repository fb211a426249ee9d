"""Verbs on register tables: union, similarity, coarser groups and formats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantize import quantize
from ..spec import QuantizationMode, SketchSpec
from .estimate import estimate
from .keys import by_inner_names, inner, inward, names, outward, quoted
from .registers import clamped, merged


def merge(tables: Sequence[tuple[DataFrame, SketchSpec]], keys: str | Sequence[str] = ()) -> DataFrame:
    """The registers of the union of all streams, key by key. All parameters must be equal, the seed too."""
    first = tables[0][1]
    if not first.is_mergeable:
        raise ValueError(f"{first.kind} depends on the order of rows and cannot be merged")
    for _, spec in tables[1:]:
        first.check_same(spec)
    keys = names(keys)
    return outward(merged(reduce(DataFrame.unionByName, [inward(t, keys) for t, _ in tables]), first, inner(keys)), keys)


@by_inner_names
def rollup(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """Coarser groups from finer registers, without another look at the rows."""
    if not spec.is_mergeable:
        raise ValueError(f"{spec.kind} depends on the order of rows and cannot be merged")
    return merged(registers, spec, names(keys))


@by_inner_names
def cube(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str]) -> DataFrame:
    """All groupings of ``keys`` at once; a key that is rolled up is null, and ``level`` is its grouping id."""
    keys = names(keys)
    join = F.min if spec.traits.least else F.max
    sets = [[*some, "i"] for n in range(len(keys) + 1) for some in combinations(keys, n)]
    out = registers.groupingSets(sets, *keys, "i").agg(join("r").alias("r"), F.grouping_id().alias("level"))
    # the last bit is that of i, which every set holds
    return clamped(out.withColumn("level", F.shiftright("level", 1)), spec, [*keys, "level"])


def jaccard(a: DataFrame, b: DataFrame, spec: SketchSpec, other: SketchSpec | None = None, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, jaccard``: the share of registers that are equal on both sides; empty on both sides counts as equal.

    It estimates the weight of the elements with equal weights on both sides over that of the union by greatest
    weight: the weighted Jaccard similarity where shared elements weigh the same. A null key is a key like any other;
    a key that only one side has is compared with an empty sketch.
    """
    if not spec.has_jaccard:
        raise ValueError(f"{spec.kind} has no Jaccard estimate")
    spec.check_same(other or spec)
    keys = names(keys)
    inside, none = inner(keys), F.lit(None)
    left, right = (inward(t, keys).select(*inside, "i", "r") for t in (a, b))
    kind = left.schema["r"].dataType
    sides = left.withColumnRenamed("r", "_ra").withColumn("_rb", none.cast(kind)).unionByName(right.withColumnRenamed("r", "_rb").withColumn("_ra", none.cast(kind)))
    both = sides.groupBy(*inside, "i").agg(F.max("_ra").alias("_ra"), F.max("_rb").alias("_rb"))
    same = F.sum(F.col("_ra").eqNullSafe(F.col("_rb")).cast("int"))
    got = both.groupBy(*inside).agg(same.alias("_same"), F.count("*").alias("_n"))
    share = (F.coalesce("_same", F.lit(0)) + F.lit(spec.m) - F.col("_n")) / F.lit(float(spec.m))
    return outward(got.select(*inside, share.alias("jaccard")), keys)


def all_pairs(registers: DataFrame, spec: SketchSpec, key: str, least: float = 0.0) -> DataFrame:
    """``key_a, key_b, jaccard`` of every two keys that share a register, ``key_a < key_b``, from ``least`` on.

    The distributed form of ``jaccard``: keys meet by an equi-join on number and value of a register, so keys without
    an equal register never meet, and counts are added up before they are dealt out. A null key is left out. The
    registers must have one row per key and number. Keys with equal sketches do all meet: that is the result asked for.
    """
    if not spec.has_jaccard:
        raise ValueError(f"{spec.kind} has no Jaccard estimate")
    one = inward(registers, [key]).select("_key0_", "i", "r").where("_key0_ is not null")
    a, b = (one.select(F.col("_key0_").alias(f"key_{s}"), F.col("i").alias(f"i_{s}"), F.col("r").alias(f"r_{s}")) for s in "ab")
    met = a.join(b, (F.col("i_a") == F.col("i_b")) & (F.col("r_a") == F.col("r_b")) & (F.col("key_a") < F.col("key_b")))
    both = met.groupBy("key_a", "key_b").agg(F.count("*").alias("_same"))
    return both.select("key_a", "key_b", (F.col("_same") / F.lit(float(spec.m))).alias("jaccard")).where(F.col("jaccard") >= least)


def set_sizes(a: DataFrame, b: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, size_a, size_b, size_union, size_intersection, size_difference`` of two sketches per key.

    The intersection is the Jaccard estimate times the union's, the difference (``a`` without ``b``) the union less ``b``,
    not under 0. A key that one side lacks is an empty sketch there; a null key is a key like any other.
    """
    keys, inside = names(keys), inner(names(keys))
    left, right = (inward(t, keys).select(*inside, "i", "r") for t in (a, b))
    parts = [
        estimate(left, spec, inside).withColumnRenamed("estimate", "v").withColumn("_n", F.lit("a")),
        estimate(right, spec, inside).withColumnRenamed("estimate", "v").withColumn("_n", F.lit("b")),
        estimate(merged(left.unionByName(right), spec, inside), spec, inside).withColumnRenamed("estimate", "v").withColumn("_n", F.lit("u")),
        jaccard(left, right, spec, keys=inside).withColumnRenamed("jaccard", "v").withColumn("_n", F.lit("j")),
    ]
    got = reduce(DataFrame.unionByName, parts).groupBy(*inside).pivot("_n", ["a", "b", "u", "j"]).agg(F.first("v")).fillna(0.0, ["a", "b", "u", "j"])
    out = got.select(*inside, F.col("a").alias("size_a"), F.col("b").alias("size_b"), F.col("u").alias("size_union"), (F.col("u") * F.col("j")).alias("size_intersection"), F.greatest(F.col("u") - F.col("b"), F.lit(0.0)).alias("size_difference"))
    return outward(out, keys)


def moving_union(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str], time: str, before: int) -> DataFrame:
    """``keys, time, i, r``: at each ``time`` of a key, the union of its sketches from ``time - before`` to ``time``.

    ``time`` is a whole number (a day, or epoch seconds) and not one of ``keys``; registers are one row per key, time and
    number. A register that is empty at a time but not in the range before it is filled, so every time of a key
    sees the whole range. Windows run per key and register, so a hot key is spread over its registers.
    """
    if not names(keys):
        return moving_union(registers.withColumn("_all", F.lit(0)), spec, ["_all"], time, before).drop("_all")
    keys = names(keys)
    inside = inner(keys)
    one = inward(registers, keys).select(*inside, quoted(time).cast("long").alias("_time"), "i", "r")
    # every register of a key at every time that the key has
    grid = one.select(*inside, "_time").distinct().join(one.select(*[F.col(k).alias(f"_b{k}") for k in inside], "i").distinct(), _same(inside))
    grid = grid.select(*inside, "_time", "i", F.lit(None).cast(one.schema["r"].dataType).alias("r"))
    past = Window.partitionBy(*inside, "i").orderBy("_time").rangeBetween(-before, 0)
    join = F.min if spec.traits.least else F.max
    rows = one.unionByName(grid).groupBy(*inside, "_time", "i").agg(join("r").alias("r"))
    got = rows.withColumn("r", join("r").over(past)).where("r is not null")
    got = clamped(got, spec, [*inside, "_time"]).withColumnRenamed("_time", time)
    return outward(got, keys)


def _same(inside: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in inside])


def clone_with(registers: DataFrame, spec: SketchSpec, exp_bits: int, mant_bits: int) -> tuple[DataFrame, SketchSpec]:
    """The same sketch in a coarser custom-float format; equal to one built in that format."""
    if spec.exp_bits is None:
        raise ValueError(f"{spec.kind} has no custom float format")
    if exp_bits > spec.exp_bits or mant_bits > spec.mant_bits:
        raise ValueError("a clone cannot have more bits than its sketch")
    coarse = spec.with_(exp_bits=exp_bits, mant_bits=mant_bits)
    return registers.withColumn("r", quantize(F.col("r"), exp_bits, mant_bits, QuantizationMode.ALL_NORMAL)), coarse


def empty_value(spec: SketchSpec):
    """What an empty register reads as when a table is made dense."""
    if spec.kind.startswith("LogExp"):
        return spec.capacity
    if spec.kind in ("WeightedMinHash", "HyperLogLog"):
        return 0
    if spec.kind == "kQSketchShifted":
        return -1022
    if spec.traits.value == "int":
        return spec.r_min
    return float("inf")


@by_inner_names
def dense(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, registers, offset``: all registers of a key as one array; integer kinds that shift are relative to ``offset``."""
    keys = names(keys)
    shifted = spec.kind.endswith("Shifted") and not spec.kind.endswith("NoShifted")
    got = registers.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("_m"), F.min("r").alias("_low"))
    offset = F.col("_low") if shifted else F.lit(0)
    kind = {"double": "double", "float": "float", "int": "int"}[spec.traits.value]
    value = lambda i: F.coalesce(F.col("_m")[i], F.lit(empty_value(spec)).cast(kind))
    rows = F.transform(F.sequence(F.lit(0), F.lit(spec.m - 1)), lambda i: (value(i) - offset).cast(kind) if shifted else value(i))
    return got.select(*keys, rows.alias("registers"), F.coalesce(offset, F.lit(0)).cast("int").alias("offset"))
