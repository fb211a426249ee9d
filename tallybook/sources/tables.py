"""Batch and streaming readers, and the store of sketches."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import code_values, float_codes, pack, register_bits, unpack
from ..operators.combine import dense
from ..operators.keys import names, quoted
from ..spec import SketchSpec


def table(spark: SparkSession, path: str, name: str | None = None, kind: str = "parquet", **options) -> DataFrame:
    """A table in any format that Spark reads (parquet, orc, csv, json, jdbc, text ...)."""
    return spark.read.format(kind).options(**options).load(f"{path}/{name}.{kind}" if name else path)


def stream(spark: SparkSession, path: str, schema, kind: str = "parquet", time: str | None = None, **options) -> DataFrame:
    """A stream of files; a ``time`` column without a zone is made a timestamp, so that it can carry a watermark."""
    got = spark.readStream.format(kind).schema(schema).options(**options).load(path)
    return got.withColumn(time, F.col(time).cast("timestamp")) if time else got


STATE = "spec string, registers binary, offset int"


def to_state(registers: DataFrame, spec: SketchSpec, keys=()) -> DataFrame:
    """``keys, spec, registers, offset``: one self-describing row per key, integer and custom-float registers bit-packed."""
    keys = names(keys)
    said, bits = json.dumps(spec.to_dict(), sort_keys=True), register_bits(spec)
    integer, low = spec.traits.value == "int", min(0, spec.r_min) if spec.amount_bits and not spec.kind.endswith("Shifted") else 0

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        if spec.exp_bits is not None:
            return rows.map(lambda r: pack(float_codes(r, spec.exp_bits, spec.mant_bits), bits))
        if not integer:
            return rows.map(lambda r: np.asarray(r, "<f4" if spec.traits.value == "float" else "<f8").tobytes())
        return rows.map(lambda r: pack(np.clip(np.asarray(r, np.int64) - low, 0, (1 << bits) - 1), bits))

    got = dense(registers, spec, keys)
    return got.select(*map(quoted, keys), F.lit(said).alias("spec"), packed("registers").alias("registers"), "offset")


def from_state(state: DataFrame, spec: SketchSpec, keys=()) -> DataFrame:
    """``keys, i, r`` of stored sketches; their spec must be the given one. Empty registers are left out again."""
    keys = names(keys)
    said, bits = json.dumps(spec.to_dict(), sort_keys=True), register_bits(spec)
    integer, low = spec.traits.value == "int", min(0, spec.r_min) if spec.amount_bits and not spec.kind.endswith("Shifted") else 0
    kind = {"double": "double", "float": "float", "int": "int"}[spec.traits.value]

    @F.pandas_udf(f"array<{kind}>")
    def opened(rows: pd.Series) -> pd.Series:
        if spec.exp_bits is not None:
            return rows.map(lambda r: code_values(unpack(r, bits, spec.m), spec.exp_bits, spec.mant_bits))
        if not integer:
            return rows.map(lambda r: np.frombuffer(r, "<f4" if spec.traits.value == "float" else "<f8"))
        return rows.map(lambda r: (unpack(r, bits, spec.m).astype(np.int64) + low).astype(np.int32))

    same = F.when(F.col("spec") == said, F.col("registers")).otherwise(F.raise_error(F.lit("the stored sketch has other parameters")))
    got = state.select(*map(quoted, keys), "offset", F.posexplode(opened(same)).alias("i", "r"))
    if integer:
        got = got.withColumn("r", (F.col("r") + F.col("offset")).cast("int"))
    missing = {"WeightedMinHash": 0.0, "HyperLogLog": 0}.get(spec.kind)
    if missing is not None:
        got = got.where(F.col("r") != missing)
    elif not integer:
        got = got.where(F.col("r") < float("inf"))
    elif spec.kind.endswith("NoShifted"):
        got = got.where(F.col("r") < spec.capacity)
    elif spec.amount_bits and not spec.kind.endswith("Shifted"):
        got = got.where(F.col("r") > spec.r_min)
    return got.select(*map(quoted, keys), "i", "r")


def save(registers: DataFrame, spec: SketchSpec, path: str, keys=(), mode: str = "errorifexists") -> None:
    """Writes sketches as a Parquet table; see ``to_state``."""
    to_state(registers, spec, keys).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, keys=()) -> tuple[DataFrame, SketchSpec]:
    """The registers and the spec of a saved table."""
    state = spark.read.parquet(path)
    first = state.select("spec").first()
    if first is None:
        raise ValueError(f"no sketch at {path}")
    spec = SketchSpec.from_dict(json.loads(first[0]))
    return from_state(state, spec, keys), spec
