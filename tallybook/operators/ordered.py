"""Sequential sketches: their estimate depends on the order in which rows come.

A row matters only if it changes a register. Those rows, the records, are found by a running extreme per key and
register. A row that is no record among the rows of its own task is no record at all, so tasks leave such rows out
before anything is dealt out: about ``m log n`` rows a task and key are left, however long the stream is. Windows over key
*and* register find the records among these (a hot key is spread over its registers), and the last step, which walks
through a key's records in order, is small for every key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import element_hash, mixed_np, unit_np, wrapping
from ..spec import SketchSpec
from .keys import column, inner, names, outward, quoted
from .registers import bucket_columns, register_value

_ROWS_HELD = 1 << 17  # of records that a task waits with
_RECORD = ["_o", "_x", "_w", "i", "r", "before"]


def _rows(df: DataFrame, spec: SketchSpec, keys: list[str], x: str, w: str | None, order: str, on_invalid: str) -> DataFrame:
    """``keys, _x, _w, _o``: the valid rows."""
    x, order = column(df, x), column(df, order)
    rows = df.where(x.isNotNull() & order.isNotNull())
    weight = F.lit(1.0)
    if spec.is_weighted and w is not None:
        weight = column(df, w).cast("double")
        valid = (weight > 0) & (weight < float("inf"))
        rows = rows.where(weight.isNotNull())
        if on_invalid == "drop":
            rows = rows.where(valid)
        else:
            weight = F.when(valid, weight).otherwise(F.raise_error(F.lit("a weight must be finite and positive")))
    return rows.select(*map(quoted, keys), x.cast("string").alias("_x"), weight.alias("_w"), order.alias("_o"))


def _sorted(rows: pa.RecordBatch | pa.Table, by: list[str]) -> pa.Table:
    rows = pa.table(rows) if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by]))


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def own_records(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    """Of ``_k, _o, _x, _w`` and what their registers get, the rows that are records among those of their task so far.

    Groups are told apart by 128 bits of hashes of the key.
    """
    hashed = rows.select("*", F.xxhash64("_k").alias("_g1"), F.xxhash64(F.lit(1), "_k").alias("_g2"))
    least, m = spec.traits.least, spec.m

    def of_dyn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = _sorted(now if held is None else pa.concat_tables([held, now]), ["_g1", "_g2", "i", "_o", "_x", "_w"])
            r = now["r"].to_numpy().astype(np.int64)
            new = _group_starts(*(now[c].to_numpy() for c in ("_g1", "_g2", "i")))
            # a step between groups that no register can cross, so that one running extreme serves all
            stepped = r + (np.cumsum(new) << 34)
            best = np.concatenate(([-(1 << 62)], np.maximum.accumulate(stepped)[:-1]))
            held = now.filter(pa.array((stepped > best) | new))
            if held.num_rows > _ROWS_HELD:
                yield from held.drop_columns(["_g1", "_g2"]).combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.drop_columns(["_g1", "_g2"]).combine_chunks().to_batches()

    def of_martingale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = max(64, (1 << 22) // m)
        for batch in batches:
            now = _sorted(batch, ["_g1", "_g2", "_o", "_x"])
            new = np.flatnonzero(_group_starts(*(now[c].to_numpy() for c in ("_g1", "_g2"))))
            for group, end in zip(new.tolist(), [*new[1:].tolist(), now.num_rows]):
                low = np.full((1, m), np.inf)
                for start in range(group, end, block):
                    part = now.slice(start, min(block, end - start))
                    e = -np.log(unit_np(mixed_np(part["_h"].to_numpy().view(np.uint64), np.arange(m))))
                    run = np.minimum.accumulate(np.concatenate((low, e)), axis=0)
                    row, i = np.nonzero(e < run[:-1])
                    low = run[-1:]
                    got = part.select(["_k", "_o", "_x", "_w"]).take(pa.array(row))
                    got = got.append_column("i", pa.array(i.astype(np.int32))).append_column("r", pa.array(e[row, i]))
                    yield from got.combine_chunks().to_batches()

    schema = T.StructType([*(rows.schema[c] for c in ("_k", "_o", "_x", "_w")), *T._parse_datatype_string(f"i int, r {'double' if least else 'int'}").fields])
    return hashed.mapInArrow(of_martingale if least else of_dyn, schema)


def records(df: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = (), x: str = "x", w: str | None = "w", order: str = "seq", on_invalid: str = "error") -> DataFrame:
    """``keys, _o, _x, _w, i, r, before``: the rows that change register ``i`` from ``before`` to ``r``.

    Rows that tie in ``order`` follow the element, then the weight. A repetition of an element and weight changes nothing.
    """
    if spec.traits.family != "sequential":
        raise ValueError(f"{spec.kind} does not depend on the order of rows: use build")
    keys = names(keys)
    if clash := sorted(set(keys) & set(_RECORD)):
        raise ValueError(f"keys called like columns of the result: {clash}")
    with wrapping(df.sparkSession):
        rows = _rows(df, spec, keys, x, w, order, on_invalid)
        key = F.struct(*[quoted(k).alias(n) for k, n in zip(keys, inner(keys))], F.lit(0).alias("_one")).alias("_k")
        if spec.kind == "MartingaleMinHash":
            rows = rows.select(key, "_o", "_x", "_w", element_hash(F.col("_x"), spec.seed, spec.hash).alias("_h"))
        else:
            one = bucket_columns(rows.select(key, "_x", "_w", "_o"), spec, ["_k"], "_o", "_x")
            rows = one.select("_k", "_o", "_x", "_w", "i", register_value(spec, F.col("_g")).alias("r"))
        got = own_records(rows, spec).select(*[F.col(f"_k.{n}").alias(n) for n in inner(keys)], *_RECORD[:-1])
        past = Window.partitionBy(*inner(keys), "i").orderBy("_o", "_x", "_w").rowsBetween(Window.unboundedPreceding, -1)
        if spec.traits.least:
            got = got.withColumn("before", F.min("r").over(past)).where("before is null or r < before")
        else:
            got = got.withColumn("before", F.coalesce(F.max("r").over(past), F.lit(spec.r_min))).where("r > before")
        return outward(got, keys)


def martingale(changes: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, estimate`` of a MartingaleMinHash: each row that changes a register adds one over the chance of that."""
    keys = names(keys)
    by_row = changes.groupBy(*keys, "_o", "_x").agg(F.sum(F.col("r") - F.coalesce("before", F.lit(0.0))).alias("_e"))
    past = Window.partitionBy(*keys).orderBy("_o", "_x").rowsBetween(Window.unboundedPreceding, -1)
    chance = 1 - F.exp(-F.sum("_e").over(past))  # of the sum of the registers before the row; the first row is sure
    return by_row.select(*keys, F.coalesce(1 / chance, F.lit(1.0)).alias("_e")).groupBy(*keys).agg(F.sum("_e").alias("estimate"))


class DynState:
    """Registers and running cardinality of one key of a Dyn sketch."""

    def __init__(self, spec: SketchSpec, post_update: bool = False, registers: Iterable[int] | None = None, cardinality: float = 0.0):
        self.spec, self.post, self.cardinality = spec, post_update, cardinality
        self.registers = np.full(spec.m, spec.r_min, np.int64) if registers is None else np.array(list(registers), np.int64)
        self.base, self.shift = (np.log(2.0), 1.0) if spec.kind == "QSketchDyn" else (spec.log_step, 0.5)

    def chance(self, w: float) -> float:
        """That a new element of weight ``w`` changes a register."""
        return 1.0 - float(np.mean(np.exp(-w * np.exp(-(self.registers + self.shift) * self.base))))

    def change(self, i: int, r: int, w: float) -> None:
        if r <= self.registers[i]:
            return
        if self.post:
            self.registers[i] = r
        self.cardinality += w / self.chance(w)
        self.registers[i] = r

    def histogram(self) -> list[int]:
        """How many registers hold each value from ``r_min`` on."""
        return np.bincount(self.registers - self.spec.r_min, minlength=1 << self.spec.amount_bits).tolist()


def dyn(changes: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = (), post_update: bool = False) -> DataFrame:
    """``keys, estimate, registers`` of a QSketchDyn or kQSketchRoundedDyn from its records.

    The chance of a change is taken before the register is set, as the estimate's theory wants; ``post_update`` takes
    it after, as QSketchDyn was first published.
    """
    keys = names(keys)
    schema = T.StructType([*(changes.schema[k] for k in keys), *T._parse_datatype_string("estimate double, registers array<int>").fields])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = DynState(spec, post_update)
        for r in rows.sort_values(["_o", "_x", "_w"]).itertuples():
            state.change(r.i, r.r, r.wt)
        return pd.DataFrame([[*key[: len(keys)], state.cardinality, state.registers.tolist()]], columns=schema.names)

    few = changes.select(*keys, "_o", "_x", "_w", F.col("_w").alias("wt"), "i", "r")
    if not keys:
        few = few.withColumn("_one", F.lit(0))
    return few.groupBy(*(keys or ["_one"])).applyInPandas(run, schema)


def build_ordered(df: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = (), x: str = "x", w: str | None = "w", order: str = "seq", on_invalid: str = "error", post_update: bool = False) -> DataFrame:
    """``keys, estimate`` of a sequential sketch over the rows in the order of a column."""
    keys = names(keys)
    few = df.select(*[column(df, k).alias(n) for k, n in zip(keys, inner(keys))], column(df, x).alias("_in_x"), column(df, order).alias("_in_o"), *([] if w is None or not spec.is_weighted else [column(df, w).alias("_in_w")]))
    got = records(few, spec, inner(keys), "_in_x", None if w is None else "_in_w", "_in_o", on_invalid)
    made = martingale(got, spec, inner(keys)) if spec.kind == "MartingaleMinHash" else dyn(got, spec, inner(keys), post_update).select(*inner(keys), "estimate")
    return outward(made, keys)


def last_registers(changes: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, i, r`` after all records."""
    return changes.groupBy(*names(keys), "i").agg((F.min if spec.traits.least else F.max)("r").alias("r"))
