"""Structured Streaming: registers per event-time window, and sequential sketches as state.

MIN and MAX are idempotent, so replays and repeated rows do no harm. Only rows behind the watermark are lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import wrapping
from ..operators.estimate import reconstructed
from ..operators.ordered import DynState
from ..operators.keys import by_inner_names, column, inner, names, outward
from ..operators.registers import _bucket, _independent, bucket_columns, register_value
from ..spec import SketchSpec


def window_registers(df: DataFrame, spec: SketchSpec, window: Column, keys: str | Sequence[str] = (), x: str = "x", w: str | None = "w", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``window, keys, i, r`` for a tumbling or sliding ``F.window`` or an ``F.session_window`` over ``time``.

    Works on streams (with a watermark of ``delay``) and on tables. For sketches with independent or single
    registers; those with ordered registers have the distribution of ``ExpSketch``. A weight that is not finite
    and positive is dropped, since an error would end the stream.
    """
    outer, keys = names(keys), inner(names(keys))
    if spec.traits.family not in ("independent", "bucket"):
        raise ValueError(f"{spec.kind} has no windowed form: use ExpSketch, which has the same distribution")
    with wrapping(df.sparkSession):
        rows = df.withColumn(time, F.col(time).cast("timestamp"))
        if df.isStreaming:
            rows = rows.withWatermark(time, delay)
        weight = column(df, w).cast("double") if w is not None and spec.is_weighted else F.lit(1.0)
        rows = rows.select(*[column(df, k).alias(n) for k, n in zip(outer, keys)], time, column(df, x).cast("string").alias("_x"), weight.alias("_w")).where(F.col("_x").isNotNull() & (F.col("_w") > 0) & (F.col("_w") < float("inf")))
        spread = (_bucket if spec.traits.family == "bucket" else _independent)(rows, spec, [*keys, time])
        return outward(spread.groupBy(window.alias("window"), *keys, "i").agg((F.min if spec.traits.least else F.max)("r").alias("r")), outer)


@by_inner_names
def window_sums(registers: DataFrame, spec: SketchSpec, keys: str | Sequence[str] = ()) -> DataFrame:
    """``window, keys, estimate`` of sketches whose estimate is (m-1) over a sum; a second aggregation in one stream."""
    keys = names(keys)
    if spec.traits.family != "independent":
        raise ValueError(f"{spec.kind} is estimated from a batch: use estimate in foreachBatch")
    value = 1 - F.col("r") if spec.kind == "WeightedMinHash" else reconstructed(spec, F.col("r"))
    return registers.groupBy("window", *keys).agg((F.lit(float(spec.m - 1)) / F.sum(value)).alias("estimate"))


def dyn_stream(df: DataFrame, spec: SketchSpec, key: str, x: str = "x", w: str = "w", order: str = "seq") -> DataFrame:
    """``key, estimate`` after each micro-batch of a QSketchDyn or kQSketchRoundedDyn, one state per key.

    Rows of a micro-batch are taken in the order of a column; batches follow each other. The state is the
    registers and the running sum, so it does not grow.
    """
    if spec.kind not in ("QSketchDyn", "kQSketchRoundedDyn"):
        raise ValueError(f"{spec.kind} is not a Dyn sketch")
    with wrapping(df.sparkSession):
        rows = df.select(F.col(key).alias(key), F.col(x).cast("string").alias("_x"), F.col(w).cast("double").alias("_w"), F.col(order).alias("_o"))
        rows = rows.where(F.col("_x").isNotNull() & (F.col("_w") > 0) & (F.col("_w") < float("inf")))
        one = bucket_columns(rows, spec, [key], "_o", "_x")
        one = one.select(key, "_o", "_x", F.col("_w").alias("wt"), "i", register_value(spec, F.col("_g")).alias("r"))
    said = json.dumps(spec.to_dict())

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = SketchSpec.from_dict(json.loads(said))
        held = DynState(known, registers=state.get[0], cardinality=state.get[1]) if state.exists else DynState(known)
        for r in pd.concat(list(batches)).sort_values(["_o", "_x", "wt"]).itertuples():
            held.change(r.i, r.r, r.wt)
        state.update((held.registers.tolist(), held.cardinality))
        yield pd.DataFrame({key: [name[0]], "estimate": [held.cardinality]})

    out = T.StructType([one.schema[key], T.StructField("estimate", T.DoubleType())])
    return one.groupBy(key).applyInPandasWithState(step, out, "registers array<int>, cardinality double", "update", GroupStateTimeout.NoTimeout)
