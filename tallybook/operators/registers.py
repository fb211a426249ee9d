"""From rows ``(keys, element, weight)`` to registers ``(keys, i, r)``.

A register is the MIN or MAX of a pure function of element, weight, seed and register, so registers of any partition,
day or group merge without loss, and partial aggregation does the work before a shuffle: what is dealt out are
registers, at most one per task, key and number, not elements. A repeated element counts once with its greatest weight
by itself; reducing rows to that first only saves work, which pays for a shuffle of the elements where each becomes
many values (``dedup``).

``relational`` expands each element into its registers inside whole-stage code; ``arrow`` computes whole blocks of
elements by registers in numpy and sends out one array per key and task. Both give the same registers, up to the
last bit of a floating-point logarithm or sum. ``auto`` takes the second for the ordered family, whose relational
form sorts every element's registers twice, and from 128 registers on.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import derived_seeds, element_hash, mixed, mixed_np, murmur64, to_unit_interval, unit, unit_np, wrapping
from ..functions.quantize import quantize, quantize_np
from ..spec import QuantizationMode, SketchSpec
from .keys import column, inner, names, outward, quoted

TINY = 1e-300  # stands for an exponential of exactly 0, whose logarithm would not be finite
LN2 = 0.6931471805599453
R_TYPES = {"double": "double", "float": "float", "int": "int"}


def valid_rows(df: DataFrame, spec: SketchSpec, keys: Sequence[str] = (), x: str = "x", w: str | None = "w", on_invalid: str = "error") -> DataFrame:
    """``keys, _x, _w``: rows as they are, with weight 1 for unweighted sketches or without ``w``.

    Rows with a null element or weight are ignored, as SQL aggregates do. A weight that is not finite and positive
    is an error, or dropped with ``on_invalid='drop'``.
    """
    if on_invalid not in ("error", "drop"):
        raise ValueError("on_invalid is error or drop")
    keys, x = [quoted(k) for k in names(keys)], column(df, x)
    rows = df.where(x.isNotNull())
    if w is None or not spec.is_weighted:
        return rows.select(*keys, x.cast("string").alias("_x"), F.lit(1.0).alias("_w"))
    weight = column(df, w).cast("double")
    valid = (weight > 0) & (weight < float("inf"))
    rows = rows.where(weight.isNotNull())
    if on_invalid == "drop":
        rows = rows.where(valid)
    else:
        weight = F.when(valid, weight).otherwise(F.raise_error(F.lit("a weight must be finite and positive")))
    return rows.select(*keys, x.cast("string").alias("_x"), weight.alias("_w"))


def deduplicated(df: DataFrame, spec: SketchSpec, keys: Sequence[str] = (), x: str = "x", w: str | None = "w", on_invalid: str = "error") -> DataFrame:
    """``keys, _x, _w``: every element of a key once, with its greatest weight."""
    return valid_rows(df, spec, keys, x, w, on_invalid).groupBy(*map(quoted, names(keys)), "_x").agg(F.max("_w").alias("_w"))


def register_value(spec: SketchSpec, g: Column) -> Column:
    """What a register holds for an exponential ``g`` (or an order statistic of it); absolute for shifted kinds."""
    kind, nearest = spec.kind, lambda c: F.floor(c + 0.5)
    if spec.traits.value == "float":
        return g.cast("float")
    if kind.startswith("LogExp"):
        index = nearest(F.ln(F.greatest(g, F.lit(TINY)) / F.lit(spec.scale)) / F.lit(spec.log_step))
        if kind.endswith("NoShifted"):
            index = F.least(F.greatest(index, F.lit(0)), F.lit(spec.capacity))
        return index.cast("int")
    if spec.traits.value == "int":
        size = F.ln(F.greatest(g, F.lit(TINY)))
        if kind.startswith("QSketch"):
            index = F.floor(-size / F.lit(LN2))
        elif kind.startswith("kQSketchRound"):
            index = nearest(-size / F.lit(spec.log_step))
        else:
            index = F.floor(-size / F.lit(spec.log_step))
        if kind != "kQSketchShifted":
            index = F.least(F.greatest(index, F.lit(spec.r_min)), F.lit(spec.r_max))
        return index.cast("int")
    if spec.exp_bits is not None:
        return quantize(g, spec.exp_bits, spec.mant_bits, QuantizationMode.ALL_NORMAL)
    return g


def register_value_np(spec: SketchSpec, g: np.ndarray) -> np.ndarray:
    kind = spec.kind
    if spec.traits.value == "float":
        return g.astype(np.float32)
    if spec.traits.value == "int":
        size = np.log(np.maximum(g, TINY))
        if kind.startswith("LogExp"):
            index = np.floor(np.log(np.maximum(g, TINY) / spec.scale) / spec.log_step + 0.5)
            return (np.clip(index, 0, spec.capacity) if kind.endswith("NoShifted") else index).astype(np.int32)
        if kind.startswith("QSketch"):
            index = np.floor(-size / LN2)
        elif kind.startswith("kQSketchRound"):
            index = np.floor(-size / spec.log_step + 0.5)
        else:
            index = np.floor(-size / spec.log_step)
        return (index if kind == "kQSketchShifted" else np.clip(index, spec.r_min, spec.r_max)).astype(np.int32)
    if spec.exp_bits is not None:
        return quantize_np(g, spec.exp_bits, spec.mant_bits, QuantizationMode.ALL_NORMAL)
    return g


def merged(registers: DataFrame, spec: SketchSpec, keys: Sequence[str]) -> DataFrame:
    """The register lattice: MIN or MAX per key and register, then the window of shifted kinds."""
    join = F.min if spec.traits.least else F.max
    return clamped(registers.groupBy(*keys, "i").agg(join("r").alias("r")), spec, keys)


def clamped(registers: DataFrame, spec: SketchSpec, keys: Sequence[str]) -> DataFrame:
    """``kQSketchShifted`` keeps ``amount_bits`` per register: the window's top is the greatest register.

    Its window only moves up, and no lower than -1022. Other kinds are unchanged.
    """
    if spec.kind != "kQSketchShifted":
        return registers
    top = F.max("r").over(Window.partitionBy(*keys)) if keys else F.max("r").over(Window.partitionBy(F.lit(0)))
    return registers.withColumn("r", F.greatest("r", top - spec.capacity, F.lit(-1022)).cast("int"))


def _hashed(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    return rows.withColumn("_h", element_hash(F.col("_x"), spec.seed, spec.hash))


def _independent(rows: DataFrame, spec: SketchSpec, keys: list[str]) -> DataFrame:
    spread = _hashed(rows, spec).select(*keys, "_w", "_h", F.explode(F.sequence(F.lit(0), F.lit(spec.m - 1))).alias("i"))
    u = unit(mixed(F.col("_h"), F.col("i")))
    if spec.kind == "WeightedMinHash":
        return spread.select(*keys, "i", F.pow(u, 1.0 / F.col("_w")).alias("r"))
    return spread.select(*keys, "i", (-F.ln(u) / F.col("_w")).alias("_g")).select(*keys, "i", register_value(spec, F.col("_g")).alias("r"))


def _ordered(rows: DataFrame, spec: SketchSpec, keys: list[str]) -> DataFrame:
    m = spec.m
    spread = _hashed(rows, spec).select(*keys, "_x", "_w", "_h", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_k"))
    spread = spread.select(
        *keys, "_x", "_k",
        (-F.ln(unit(mixed(F.col("_h"), F.col("_k")))) / F.col("_w") / (F.lit(m) - F.col("_k"))).alias("_e"),
        F.shiftrightunsigned(mixed(F.col("_h"), F.col("_k") + m), 12).alias("_p"),
    )
    by = Window.partitionBy(*keys, "_x")
    s = F.sum("_e").over(by.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    i = F.row_number().over(by.orderBy("_p", "_k")) - 1
    return spread.select(*keys, i.alias("i"), s.alias("_g")).select(*keys, "i", register_value(spec, F.col("_g")).alias("r"))


def bucket_columns(rows: DataFrame, spec: SketchSpec, keys: Sequence[str], *more: str) -> DataFrame:
    """``keys, i, g`` (and ``rho``): the one register of an element, and what it gets."""
    m = spec.m
    h = _hashed(rows, spec)
    # Dyn kinds choose the register by a hash of their own, which is the same one where the seeds are equal
    own = F.col("_h") if spec.traits.family != "sequential" or spec.g_seed == spec.seed else element_hash(F.col("_x"), spec.g_seed, spec.hash)
    g = -F.ln(unit(mixed(F.col("_h"), F.lit(2 * m + 1)))) / F.col("_w")
    out = h.select(*keys, *more, "_w", F.pmod(F.shiftrightunsigned(mixed(own, F.lit(2 * m)), 12), F.lit(m)).cast("int").alias("i"), g.alias("_g"), F.shiftrightunsigned(mixed(F.col("_h"), F.lit(2 * m + 2)), 12).alias("_z"))
    rho = F.when(F.col("_z") == 0, F.lit(53)).otherwise(F.lit(53) - F.length(F.bin("_z"))).cast("int")
    return out.select(*keys, *more, "_w", "i", "_g", rho.alias("_rho"))


def _bucket(rows: DataFrame, spec: SketchSpec, keys: list[str]) -> DataFrame:
    one = bucket_columns(rows, spec, keys)
    value = F.col("_rho") if spec.kind == "HyperLogLog" else register_value(spec, F.col("_g"))
    return one.select(*keys, "i", value.alias("r"))


_BYTES_HELD = 64 << 20  # of registers that a task holds at once


def block_exponentials(spec: SketchSpec, h: np.ndarray | None, elements: list[bytes] | None, w: np.ndarray) -> np.ndarray:
    """What a block of elements brings, rows by registers: exponentials, their order statistics, or powers of uniforms."""
    m = spec.m
    ordered = spec.traits.family == "ordered"
    if spec.hash == "murmur3":
        seeds = derived_seeds(spec.seed, m)
        u = np.vstack([to_unit_interval(murmur64(x, seeds)) for x in elements])
        order_by = np.vstack([murmur64(x, np.arange(1, m + 1, dtype=np.uint64) << np.uint64(32)) for x in elements]) if ordered else None
    else:
        u = unit_np(mixed_np(h, np.arange(m)))
        order_by = mixed_np(h, np.arange(m, 2 * m)) >> np.uint64(12) if ordered else None
    if spec.kind == "WeightedMinHash":
        return u ** (1.0 / w[:, None])
    e = -np.log(u) / w[:, None]
    if not ordered:
        return e
    s = np.cumsum(e / np.arange(m, 0, -1), axis=1)
    return np.take_along_axis(s, np.argsort(order_by, axis=1, kind="stable"), axis=1)


def _grouped(keys: pa.StructArray) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key, and the keys by number; rows are told apart column by column, without Python objects."""
    codes = np.zeros(len(keys), np.int64)
    for n in range(len(keys.type)):
        column_ = keys.field(n).dictionary_encode(null_encoding="encode")
        if len(column_.dictionary) > 1:
            codes = np.unique(codes * len(column_.dictionary) + column_.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].ravel()
    _, first = np.unique(codes, return_index=True)
    some = keys.take(pa.array(first))
    return codes, list(zip(*(some.field(n).to_pylist() for n in range(len(keys.type)))))


def _arrow(rows: DataFrame, spec: SketchSpec, keys: list[str]) -> DataFrame:
    """Registers per task and key. They are held as exponentials and brought to their form at the end, as that is monotone.

    The first order statistic of an element is its least: where it is no less than a key's greatest register, the
    element changes nothing and is left out. So most elements of a long stream, and all repetitions, cost one hash.
    """
    own = F.col("_x") if spec.hash == "murmur3" else element_hash(F.col("_x"), spec.seed, spec.hash)
    rows = rows.select(F.struct(*keys, F.lit(0).alias("_one")).alias("_k"), own.alias("_h"), "_w")
    highest, kind = spec.kind == "WeightedMinHash", {"double": pa.float64(), "float": pa.float32(), "int": pa.int32()}[spec.traits.value]
    lower = np.maximum if highest else np.minimum
    prune = spec.traits.family == "ordered" and spec.hash != "murmur3"
    block = max(64, (1 << (16 if prune else 19)) // spec.m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out():
            some = [dict(zip(fields, k)) for k in held]
            made = [v if highest else register_value_np(spec, v) for v in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, key_type), pa.array(made, pa.list_(kind))], names=["_k", "_rs"])

        for batch in batches:
            key_type = batch.column(0).type
            fields = [f.name for f in key_type]
            group, known = _grouped(batch.column(0))
            w = batch.column(2).to_numpy()
            h = None if spec.hash == "murmur3" else batch.column(1).to_numpy().view(np.uint64)
            least = -np.log(unit_np(mixed_np(h, np.arange(1)))[:, 0]) / w / spec.m if prune else None
            left = np.arange(batch.num_rows)
            while len(left):
                if prune:
                    limit = np.array([held[k].max() if k in held else np.inf for k in known])
                    left = left[least[left] < limit[group[left]]]
                part, left = left[:block], left[block:]
                if not len(part):
                    break
                elements = [x.encode() for x in batch.column(1).take(pa.array(part)).to_pylist()] if h is None else None
                values = block_exponentials(spec, None if h is None else h[part], elements, w[part])
                order = np.argsort(group[part], kind="stable")
                ids = group[part][order]
                starts = np.flatnonzero(np.diff(ids, prepend=-1))
                for k, r in zip(ids[starts].tolist(), lower.reduceat(values[order], starts, axis=0)):
                    held[known[k]] = lower(held[known[k]], r) if known[k] in held else r
            if len(held) * 8 * spec.m > _BYTES_HELD:
                yield out()
        if held:
            yield out()

    inner = T._parse_datatype_string(R_TYPES[spec.traits.value])
    schema = T.StructType([rows.schema["_k"], T.StructField("_rs", T.ArrayType(inner))])
    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], F.posexplode("_rs").alias("i", "r"))


def build(df: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = (), x: str = "x", w: str | None = "w", method: str = "auto", on_invalid: str = "error", dedup: bool | None = None) -> DataFrame:
    """The registers of every key: ``keys, i, r``. Sequential kinds have their own builder (``ordered.build_ordered``).

    ``dedup`` reduces rows to one per element first, at the cost of a shuffle of the elements; the registers are the
    same with and without. A key may have any name but ``i`` and ``r``. By default that is done where an element becomes many rows or columns, and not for kinds with
    one register per element or for ordered kinds in the Arrow form, which leave out repetitions themselves. An
    empty register is a missing row. No rows give no registers.
    """
    if spec.traits.family == "sequential":
        raise ValueError(f"{spec.kind} depends on the order of rows: use build_ordered")
    if method not in ("auto", "relational", "arrow"):
        raise ValueError("method is auto, relational or arrow")
    keys, outer, family = inner(names(keys)), names(keys), spec.traits.family
    if method == "auto":
        method = "arrow" if spec.hash == "murmur3" or family == "ordered" or (family == "independent" and spec.m >= 128) else "relational"
    if spec.hash == "murmur3" and (method != "arrow" or family == "bucket"):
        raise ValueError("murmur3 is for the arrow method, and not for kinds with one register per element")
    numpy = method == "arrow" and family != "bucket"
    if dedup is None:
        dedup = family == "independent" or spec.hash == "murmur3"
    # the window form tells elements apart by their text, so it always needs them once
    dedup = dedup or (family == "ordered" and not numpy)
    few = df.select(*[column(df, k).alias(n) for k, n in zip(outer, keys)], column(df, x).alias("_in_x"), *([] if w is None or not spec.is_weighted else [column(df, w).alias("_in_w")]))
    with wrapping(df.sparkSession):
        rows = (deduplicated if dedup else valid_rows)(few, spec, keys, "_in_x", None if w is None else "_in_w", on_invalid)
        if numpy:
            spread = _arrow(rows, spec, keys)
        else:
            spread = {"independent": _independent, "ordered": _ordered, "bucket": _bucket}[family](rows, spec, keys)
        return outward(merged(spread, spec, keys), outer)


class ManyHeld:
    """What a task holds of several sketches: per form an array of keys by registers, NaN where empty.

    Sketches of one form differ only in how they write down an exponential (or power, or rank), which is monotone, so
    the form is held once and written down at the end. What an element brings at best is known from one hash (ordered
    kinds) or from the greatest of its hashes, before any logarithm: where that changes no register of its key, as for
    most elements of a long stream and all repetitions, the element is left out.
    """

    def __init__(self, kinds: Sequence[SketchSpec]):
        self.forms = {self.form(spec): spec for spec in kinds}
        self.each = 8 * (sum(s.m for s in kinds) + sum(s.m for s in self.forms.values()))  # bytes of a key, written down and held
        self.step = min(1 << 14, max(64, _BYTES_HELD // self.each))  # rows, and so new keys, at a time
        self.clear()

    @staticmethod
    def form(spec: SketchSpec) -> tuple:
        return spec.traits.family, spec.m, spec.is_weighted, spec.kind if spec.kind in ("WeightedMinHash", "HyperLogLog") else ""

    def clear(self) -> None:
        self.slots: dict[tuple, int] = {}
        self.held = {form: np.empty((0, spec.m)) for form, spec in self.forms.items()}

    def registers(self, spec: SketchSpec) -> np.ndarray:
        """Keys, in the order of ``slots``, by registers."""
        out = self.held[self.form(spec)][: len(self.slots)].copy()
        if spec.kind not in ("WeightedMinHash", "HyperLogLog"):
            some = ~np.isnan(out)
            out[some] = register_value_np(spec, out[some])
        return out

    def add(self, known: Sequence[tuple], group: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        """Rows of the keys ``known[group]``, with the elements' hashes and their weights."""
        slots, again = np.unique([self.slots.setdefault(k, len(self.slots)) for k in known], return_inverse=True)
        group = again.ravel()[group]  # keys that are told apart but equal, as 0.0 and -0.0, share a slot
        tops = self._tops(h)
        for form, spec in self.forms.items():
            if len(self.held[form]) < len(self.slots):
                more = max(len(self.slots), 2 * len(self.held[form])) - len(self.held[form])
                self.held[form] = np.concatenate([self.held[form], np.full((more, spec.m), np.nan)])
            now = self.held[form][slots]
            weight = w if spec.is_weighted else np.ones(len(w))
            if spec.traits.family == "bucket":
                self._bucket(spec, now, group, h, weight)
            else:
                self._dense(spec, now, group, h, weight, tops.get(spec.m))
            self.held[form][slots] = now

    def _tops(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """The greatest of the first m mixed values of each element, by m, for the independent forms."""
        wanted, out, top = {s.m for s in self.forms.values() if s.traits.family == "independent"}, {}, np.zeros(len(h), np.uint64)
        for i in range(max(wanted, default=0)):
            np.maximum(top, mixed_np(h, np.arange(i, i + 1)).ravel(), out=top)
            if i + 1 in wanted:
                out[i + 1] = top.copy()
        return out

    @staticmethod
    def _bucket(spec: SketchSpec, now: np.ndarray, group: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        m, highest, flat = spec.m, spec.kind == "HyperLogLog", now.reshape(-1)
        draws = mixed_np(h, np.arange(2 * m, 2 * m + 3))
        cell = group * m + ((draws[:, 0] >> np.uint64(12)) % np.uint64(m)).astype(np.int64)
        if highest:
            value = 53.0 - np.frexp((draws[:, 2] >> np.uint64(12)).astype(np.float64))[1]
        else:
            value = -np.log(unit_np(draws[:, 1])) / w
        some = ~(value <= flat[cell] if highest else value >= flat[cell])  # also where there is none yet
        (np.fmax if highest else np.fmin).at(flat, cell[some], value[some])

    @staticmethod
    def _dense(spec: SketchSpec, now: np.ndarray, group: np.ndarray, h: np.ndarray, w: np.ndarray, top: np.ndarray | None) -> None:
        m, highest = spec.m, spec.kind == "WeightedMinHash"
        if highest:
            best = unit_np(top) ** (1.0 / w)
        elif spec.traits.family == "ordered":
            best = -np.log(unit_np(mixed_np(h, np.arange(1)).ravel())) / w / m
        else:
            best = -np.log(unit_np(top)) / w
        join, end = (np.maximum, np.min) if highest else (np.minimum, np.max)
        limit, block, left = end(now, axis=1), max(64, (1 << 16) // m), np.arange(len(h))
        while len(left):
            left = left[~(best[left] <= limit[group[left]] if highest else best[left] >= limit[group[left]])]
            part, left = left[:block], left[block:]
            if not len(part):
                break
            order = np.argsort(group[part], kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.diff(group[part], prepend=-1))
            some = group[part[starts]]
            made = join.reduceat(block_exponentials(spec, h[part], None, w[part]), starts, axis=0)
            now[some] = np.where(np.isnan(now[some]), made, join(now[some], made))
            limit[some] = end(now[some], axis=1)


def build_many(df: DataFrame, specs: Mapping[str, SketchSpec], keys: str | Sequence[str] = (), x: str = "x", w: str | None = "w", on_invalid: str = "error") -> DataFrame:
    """The registers of several sketches from one pass over the rows: ``keys, sketch, i, r``, where ``r`` is a double.

    All specs share a seed and a hash family (portable or xx), so an element is hashed once; ``sketch`` is a name of
    ``specs``. Elements that can change a register are brought to the registers of each sketch in numpy (``ManyHeld``), and
    one array per key, sketch and task is dealt out. Unweighted kinds take weight 1. ``one_of`` gives the registers of one
    sketch, as ``build`` makes them; each use of the result is a pass of its own, unless it is cached or written first.
    """
    specs = dict(specs)
    first = next(iter(specs.values()), None)
    if first is None:
        raise ValueError("no sketch is asked for")
    for spec in specs.values():
        if spec.traits.family == "sequential":
            raise ValueError(f"{spec.kind} depends on the order of rows: use build_ordered")
        if spec.hash == "murmur3" or (spec.seed, spec.hash) != (first.seed, first.hash):
            raise ValueError("sketches of one pass share a seed, and a hash family that is not murmur3")
    outer, keys = names(keys), inner(names(keys))
    weighted = next((s for s in specs.values() if s.is_weighted), first)
    few = df.select(*[column(df, k).alias(n) for k, n in zip(outer, keys)], column(df, x).alias("_in_x"), *([] if w is None or not weighted.is_weighted else [column(df, w).alias("_in_w")]))
    kinds = list(specs.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ManyHeld(kinds)

        def out() -> pa.RecordBatch:
            some = [dict(zip(fields, k)) for k in held.slots] * len(kinds)
            which = np.repeat(np.arange(len(kinds), dtype=np.int32), len(held.slots))
            made = [held.registers(spec) for spec in kinds]
            ends = np.cumsum([0, *np.repeat([spec.m for spec in kinds], len(held.slots))]).astype(np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, key_type), pa.array(which), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made, axis=None)))], names=["_k", "_s", "_rs"])

        for batch in batches:
            key_type = batch.column(0).type
            fields = [f.name for f in key_type]
            for at in range(0, batch.num_rows, held.step):
                part = batch.slice(at, held.step)
                group, known = _grouped(part.column(0))
                held.add(known, group, part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy())
                if len(held.slots) * held.each > _BYTES_HELD:
                    yield out()
        if held.slots:
            yield out()

    with wrapping(df.sparkSession):
        rows = valid_rows(few, weighted, keys, "_in_x", None if w is None else "_in_w", on_invalid)
        rows = rows.select(F.struct(*keys, F.lit(0).alias("_one")).alias("_k"), element_hash(F.col("_x"), first.seed, first.hash).alias("_h"), "_w")
    schema = T.StructType([rows.schema["_k"], *T._parse_datatype_string("_s int, _rs array<double>").fields])
    made = rows.mapInArrow(run, schema).select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], "_s", F.posexplode("_rs").alias("i", "r")).where(~F.isnan("r"))
    lattice = made.groupBy(*keys, "_s", "i").agg(F.min("r").alias("_low"), F.max("r").alias("_high"))
    least = F.col("_s").isin([n for n, s in enumerate(kinds) if s.traits.least])
    r = F.when(least, F.col("_low")).otherwise(F.col("_high"))
    shifted = [(n, s.capacity) for n, s in enumerate(kinds) if s.kind == "kQSketchShifted"]
    if shifted:  # as ``clamped``, of several sketches at once
        top = F.max("_high").over(Window.partitionBy(*keys, "_s"))
        lattice = lattice.withColumn("_top", top)
        for n, capacity in shifted:
            r = F.when(F.col("_s") == n, F.greatest("_high", F.col("_top") - capacity, F.lit(-1022.0))).otherwise(r)
    label = F.element_at(F.array(*map(F.lit, specs)), F.col("_s") + 1)
    return outward(lattice.select(*keys, label.alias("sketch"), "i", r.alias("r")), outer)


def one_of(many: DataFrame, name: str, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """The registers of one sketch of ``build_many``: ``keys, i, r`` in the sketch's own type."""
    keys = names(keys)
    own = many.where(F.col("sketch") == name)
    own = own.select(*[quoted(k).alias(n) for k, n in zip(keys, inner(keys))], "i", F.col("r").cast(R_TYPES[spec.traits.value]).alias("r"))
    return outward(clamped(own, spec, inner(keys)), keys)
