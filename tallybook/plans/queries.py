"""One query per sketch and verb over the test tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import spec as S
from ..functions.hashing import element_hash, mixed, unit, wrapping
from ..functions.memory import memory_usage
from ..functions.quantize import quantize
from ..operators.builtin import build_builtin, estimate_builtin, merge_builtin, set_sizes_builtin
from ..operators.combine import all_pairs, clone_with, cube, dense, jaccard, merge, moving_union, rollup, set_sizes
from ..operators.estimate import estimate, estimate_corrected, estimate_direct, newton
from ..operators.ordered import build_ordered, dyn, records
from ..operators.registers import build, build_many, deduplicated
from ..sources import generators
from ..sources.tables import from_state, table, to_state
from ..streaming.windows import window_registers, window_sums
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]

SPECS = {
    "exp": S.ExpSketch(64),
    "exp_float32": S.ExpSketchFloat32(64),
    "fast_exp": S.FastExpSketch(32),
    "fast_exp_float32": S.FastExpSketchFloat32(32),
    "fastgm": S.FastGMExpSketch(32, 7),
    "fast_exp_custom_float": S.FastExpSketchCustomFloat(32, 42, 8, 7),
    "logexp_slow_noshift": S.LogExpSketchSlowNoShifted(64, 42, 10, 1e7),
    "logexp_fast_noshift": S.LogExpSketchFastNoShifted(32, 42, 10, 1e7),
    "logexp_slow_shifted": S.LogExpSketchSlowShifted(64, 42, 12, 1e7),
    "logexp_fast_shifted": S.LogExpSketchFastShifted(32, 42, 12, 1e7),
    "qsketch": S.QSketch(32, 42, 8),
    "kqsketch": S.kQSketch(32, 42, 10, 1.2),
    "kqsketch_rounding": S.kQSketchRounding(32, 42, 10, 1.2),
    "kqsketch_shifted": S.kQSketchShifted(32, 42, 5, 1.5),
    "weighted_minhash": S.WeightedMinHash(64),
    "weighted_hll": S.WeightedHyperLogLog(64),
    "weighted_hll_float32": S.WeightedHyperLogLogFloat32(64),
    "weighted_hll_custom_float": S.WeightedHyperLogLogCustomFloat(64, 42, 8, 10),
    "minhash": S.MinHash(64),
    "hll": S.HyperLogLog(64),
}
MARTINGALE, QDYN, KQDYN = S.MartingaleMinHash(32), S.QSketchDyn(64, 42, 8), S.kQSketchRoundedDyn(64, 42, 8, 1.5)

FLAG, TYPE = ["flag"], ["kind"]
LINES = "SELECT l_returnflag AS flag, l_linestatus AS status, l_partkey::VARCHAR AS x, l_quantity AS w FROM lineitem"
EVENTS = "SELECT event_type AS kind, user_id::VARCHAR AS x, value AS w, event_id AS o, ts FROM events"

#: Rows with a weight: some events have a value of 0, which weighted sketches do not take.
WEIGHED = f"SELECT * FROM ({EVENTS}) WHERE w > 0 AND isfinite(w)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("x"), F.col("l_quantity").alias("w"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("x"), F.col("value").alias("w"), F.col("event_id").alias("o"), "ts")


def _source(spec: S.SketchSpec) -> tuple[Callable, list[str], str]:
    return (lines, FLAG, LINES) if spec.is_weighted else (events, TYPE, EVENTS)


def shown(registers: DataFrame, spec: S.SketchSpec, *keys: str) -> DataFrame:
    r = F.col("r") if spec.traits.value == "int" else F.round(F.col("r").cast("double"), 12)
    return registers.select(*keys, F.col("i").cast("int").alias("i"), r.alias("r"))


def rounded(got: DataFrame, digits: int = 3) -> DataFrame:
    return got.withColumn("estimate", F.round("estimate", digits))


def registers_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys, _ = _source(spec)
    return shown(build(rows(spark, sf_dir), spec, keys), spec, *keys)


def estimate_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys, _ = _source(spec)
    return rounded(estimate(build(rows(spark, sf_dir), spec, keys), spec, keys))


def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth that the weighted sketches estimate."""
    rows = deduplicated(lines(spark, sf_dir), SPECS["exp"], FLAG)
    return rows.groupBy("flag").agg(F.sum("_w").alias("total"), F.count("*").alias("n"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = deduplicated(lines(spark, sf_dir), SPECS["exp"], ["flag"])
    pick = lambda f, w: one.where(F.col("flag") == f).select("_x", F.col("_w").alias(w))
    return pick("A", "wa"), pick("R", "wb")


def exact_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Jaccard of two flags, and what the sketches' comparison of registers estimates."""
    a, b = _sides(spark, sf_dir)
    zero = F.lit(0.0)
    both = a.join(b, "_x", "full").select(F.coalesce("wa", zero).alias("wa"), F.coalesce("wb", zero).alias("wb"))
    top = F.sum(F.greatest("wa", "wb"))
    return both.agg(F.round(F.sum(F.least("wa", "wb")) / top, 9).alias("weighted"), F.round(F.sum(F.when(F.col("wa") == F.col("wb"), F.col("wa")).otherwise(0.0)) / top, 9).alias("matching"))


EXACT_JACCARD = f"""
WITH d AS (SELECT flag, x, max(w) AS w FROM ({LINES}) GROUP BY flag, x),
j AS (SELECT coalesce(a.w, 0) AS wa, coalesce(b.w, 0) AS wb FROM (FROM d WHERE flag = 'A') a FULL JOIN (FROM d WHERE flag = 'R') b USING (x))
SELECT round(sum(least(wa, wb)) / sum(greatest(wa, wb)), 9) AS weighted, round(sum(CASE WHEN wa = wb THEN wa ELSE 0 END) / sum(greatest(wa, wb)), 9) AS matching FROM j
"""


def merge_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and finished lines, or early and late events, are sketched apart and merged."""
    sides, keys = _halves(spec, spark, sf_dir)
    return shown(merge([(build(x, spec, keys), spec) for x in sides], keys), spec, *keys)


def rollup_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = build(lines(spark, sf_dir), spec, ["flag", "status"])
    return rounded(estimate(rollup(fine, spec, ["status"]), spec, ["status"]))


def cube_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SPECS["exp"]
    keys = ["flag", "status", "level"]
    return rounded(estimate(cube(build(lines(spark, sf_dir), spec, ["flag", "status"]), spec, ["flag", "status"]), spec, keys)).withColumn("level", F.col("level").cast("int"))


def _cube_sql() -> str:
    spec = SPECS["exp"]
    ctes = Q.registers_ctes(spec, LINES, ["flag", "status"])
    return f"""WITH {', '.join(ctes)},
    c AS (SELECT flag, status, grouping(flag, status) AS level, i, min(r) AS r FROM registers GROUP BY GROUPING SETS ((flag, status, i), (flag, i), (status, i), (i)))
    SELECT flag, status, level::INTEGER AS level, round({spec.m - 1} / sum(r), 3) AS estimate FROM c GROUP BY flag, status, level"""


def _halves(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[str]]:
    """Open and finished lines by flag, or events of the first half of the month and the rest."""
    if spec.is_weighted:
        rows = lines(spark, sf_dir)
        return [rows.where(F.col("status") == s) for s in ("F", "O")], FLAG
    rows, early = events(spark, sf_dir), F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return [rows.where(early), rows.where(~early)], TYPE


def jaccard_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    sides, keys = _halves(spec, spark, sf_dir)
    a, b = (build(x, spec, keys) for x in sides)
    return jaccard(a, b, spec, keys=keys).withColumn("jaccard", F.round("jaccard", 9))


def _jaccard_sql(spec: S.SketchSpec) -> str:
    key, source = ("flag", LINES) if spec.is_weighted else ("kind", EVENTS)
    tests = ("status = 'F'", "status = 'O'") if spec.is_weighted else ("ts < TIMESTAMP '2024-01-16'", "NOT ts < TIMESTAMP '2024-01-16'")
    a, b = (f"(WITH {', '.join(Q.registers_ctes(spec, f'SELECT * FROM ({source}) WHERE {t}', [key]))} SELECT {key}, i, r FROM registers)" for t in tests)
    return f"""SELECT coalesce(a.{key}, b.{key}) AS {key}, round((count(*) FILTER (a.r = b.r) + {spec.m} - count(*)) / {spec.m}.0::DOUBLE, 9) AS jaccard
    FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key} AND a.i = b.i GROUP BY 1"""


def direct_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimate_direct(build(lines(spark, sf_dir), spec, FLAG), spec, FLAG))


def _direct_sql(spec: S.SketchSpec) -> str:
    top = (spec.logarithm_base - 1) * spec.m / spec.log_step
    if spec.kind == "kQSketchRounding":
        return Q.estimate_sql(spec, LINES, FLAG)
    return f"WITH {', '.join(Q.registers_ctes(spec, LINES, FLAG))} SELECT flag, round({top!r}::DOUBLE / sum({Q.weight_sql(spec)}), 3) AS estimate FROM registers GROUP BY flag"


def newton_query(spec: S.SketchSpec, start: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    got = newton(build(lines(spark, sf_dir), spec, FLAG), spec, FLAG, start)
    return rounded(got).select("flag", "estimate", "iterations")


def _newton_sql(spec: S.SketchSpec, start: str) -> str:
    turns = 60 if start == "cold" else 30
    ctes = Q.registers_ctes(spec, LINES, FLAG) + Q.newton_ctes(spec, FLAG, start, turns)
    ctes += ["path AS (" + " UNION ALL ".join(f"SELECT flag, {k} AS k, w FROM n{k}" for k in range(turns)) + ")"]
    # the turns until a step is a billionth of the value at most
    ctes += ["turns AS (SELECT flag, k FROM (SELECT flag, k, w, lag(w) OVER (PARTITION BY flag ORDER BY k) AS v FROM path) WHERE abs(w - v) <= 1e-9 * abs(w))"]
    return f"WITH {', '.join(ctes)} SELECT flag, round(any_value(w), 3) AS estimate, min(k)::INTEGER AS iterations FROM n{turns - 1} JOIN turns USING (flag) GROUP BY flag"


def corrected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SPECS["kqsketch_rounding"]
    return rounded(estimate_corrected(build(lines(spark, sf_dir), spec, FLAG), spec, FLAG))


def _corrected_sql() -> str:
    import math

    spec = SPECS["kqsketch_rounding"]
    factor = 2 * math.sinh(spec.log_step / 2) / spec.log_step
    return f"WITH {', '.join(Q.registers_ctes(spec, LINES, FLAG) + Q.estimate_ctes(spec, FLAG))} SELECT flag, round(estimate * {factor!r}::DOUBLE, 3) AS estimate FROM estimates"


def clone_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built in a fine format, cloned to a coarse one."""
    fine = SPECS["fast_exp_custom_float"].with_(mant_bits=15)
    got, coarse = clone_with(build(lines(spark, sf_dir), fine, FLAG), fine, 7, 5)
    return shown(got, coarse, *FLAG)


def dense_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registers of a key as one array, a shifted kind's relative to its offset."""
    spec = SPECS[name]
    return dense(build(lines(spark, sf_dir), spec, FLAG), spec, FLAG).select("flag", F.array_join("registers", ",").alias("registers"), "offset")


def _dense_sql(name: str) -> str:
    ctes = Q.registers_ctes(SPECS[name], LINES, FLAG)
    return f"WITH {', '.join(ctes)} SELECT flag, string_agg((r - low)::VARCHAR, ',' ORDER BY i) AS registers, any_value(low) AS \"offset\" FROM (SELECT *, min(r) OVER (PARTITION BY flag) AS low FROM registers) GROUP BY flag"


def state_query(spec: S.SketchSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers packed to their stored form and back."""
    rows, keys, _ = _source(spec)
    return shown(from_state(to_state(build(rows(spark, sf_dir), spec, keys), spec, keys), spec, keys), spec, *keys)


def martingale_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_ordered(events(spark, sf_dir), MARTINGALE, TYPE, "x", None, "o"), 4)


def dyn_query(spec: S.SketchSpec, post_update: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_ordered(events(spark, sf_dir), spec, TYPE, "x", "w", "o", on_invalid="drop", post_update=post_update))


def dyn_verb_query(verb: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct and the Newton estimate of a kQSketchRoundedDyn are its running value."""
    state = dyn(records(events(spark, sf_dir), KQDYN, TYPE, "x", "w", "o", on_invalid="drop"), KQDYN, TYPE)
    return rounded(estimate_direct(state, KQDYN, TYPE) if verb == "direct" else newton(state, KQDYN, TYPE, "cold"))


def null_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard where a key is null on both sides, and another is on one side alone."""
    spec = SPECS["exp"]
    rows = lines(spark, sf_dir).withColumn("flag", F.when(F.col("flag") != "N", F.col("flag")))
    a, b = build(rows, spec, FLAG), build(rows.where("flag is null or (flag = 'A' and status = 'F')"), spec, FLAG)
    return jaccard(a, b, spec, keys=FLAG).withColumn("jaccard", F.round("jaccard", 9))


def _null_key_sql() -> str:
    spec, rows = SPECS["exp"], f"SELECT * REPLACE (nullif(flag, 'N') AS flag) FROM ({LINES})"
    a, b = (f"(WITH {', '.join(Q.registers_ctes(spec, s, FLAG))} SELECT flag, i, r FROM registers)" for s in (rows, f"SELECT * FROM ({rows}) WHERE flag IS NULL OR (flag = 'A' AND status = 'F')"))
    return f"""SELECT a.flag, round(count(*) FILTER (a.r = b.r) / {spec.m}.0::DOUBLE, 9) AS jaccard
    FROM {a} a LEFT JOIN {b} b ON a.flag IS NOT DISTINCT FROM b.flag AND a.i = b.i GROUP BY 1"""


MANY = ("exp", "exp_float32", "fast_exp", "qsketch", "kqsketch_shifted", "weighted_minhash", "weighted_hll", "hll")


def many_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers of several kinds from one pass over the lines."""
    many = build_many(lines(spark, sf_dir), {n: SPECS[n] for n in MANY}, FLAG)
    return many.select("sketch", "flag", F.col("i").cast("int").alias("i"), F.round(F.round("r", 12), 9).alias("r"))


def _many_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS sketch, flag, i, round(r::DOUBLE, 9) AS r FROM ({Q.registers_sql(SPECS[n], LINES, FLAG)})" for n in MANY)


def all_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of every two event types' users that share a register."""
    spec = SPECS["minhash"]
    return all_pairs(build(events(spark, sf_dir), spec, TYPE), spec, "kind", 0.05).withColumn("jaccard", F.round("jaccard", 9))


def _all_pairs_sql() -> str:
    spec = SPECS["minhash"]
    return f"""WITH {', '.join(Q.registers_ctes(spec, EVENTS, TYPE))}
    SELECT * FROM (SELECT a.kind AS key_a, b.kind AS key_b, round(count(*) FILTER (a.r = b.r) / {spec.m}.0::DOUBLE, 9) AS jaccard
    FROM registers a JOIN registers b ON a.i = b.i AND a.kind < b.kind GROUP BY 1, 2) WHERE jaccard >= 0.05"""


def set_sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finished and open lines have in common, and apart."""
    spec = SPECS["exp"]
    sides, keys = _halves(spec, spark, sf_dir)
    got = set_sizes(*(build(x, spec, keys) for x in sides), spec, keys)
    return got.select("flag", *[F.round(c, 3).alias(c) for c in got.columns if c != "flag"])


def _set_sizes_sql() -> str:
    spec = SPECS["exp"]
    one = lambda t: f"(WITH {', '.join(Q.registers_ctes(spec, f'SELECT * FROM ({LINES}) WHERE {t}', FLAG))} SELECT flag, i, r FROM registers)"
    m = spec.m
    return f"""WITH j AS (SELECT coalesce(a.flag, b.flag) AS flag, a.r AS ra, b.r AS rb FROM {one("status = 'F'")} a FULL JOIN {one("status = 'O'")} b ON a.flag = b.flag AND a.i = b.i),
    s AS (SELECT flag, coalesce({m - 1} / sum(ra), 0) AS a, coalesce({m - 1} / sum(rb), 0) AS b, {m - 1} / sum(least(coalesce(ra, rb), coalesce(rb, ra))) AS u, count(*) FILTER (ra = rb) / {m}.0::DOUBLE AS j FROM j GROUP BY flag)
    SELECT flag, round(a, 3) AS size_a, round(b, 3) AS size_b, round(u, 3) AS size_union, round(u * j, 3) AS size_intersection, round(greatest(u - b, 0), 3) AS size_difference FROM s"""


def moving_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's estimate over that day and the two before, from the days' registers."""
    spec, keys = S.ExpSketch(16), ["kind", "day"]
    rows = events(spark, sf_dir).withColumn("day", F.datediff("ts", F.lit("2024-01-01")))
    daily = build(rows, spec, keys, on_invalid="drop")
    return rounded(estimate(moving_union(daily, spec, TYPE, "day", 2), spec, keys)).withColumn("day", F.col("day").cast("int"))


def _moving_union_sql() -> str:
    spec = S.ExpSketch(16)
    ctes = Q.registers_ctes(spec, f"SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day FROM ({WEIGHED})", ["kind", "day"])
    ctes += ["moved AS (SELECT a.kind, a.day, b.i, min(b.r) AS r FROM (SELECT DISTINCT kind, day FROM registers) a JOIN registers b ON a.kind = b.kind AND b.day BETWEEN a.day - 2 AND a.day GROUP BY ALL)"]
    return f"WITH {', '.join(ctes)} SELECT kind, day, round({spec.m - 1} / sum(r), 3) AS estimate FROM moved GROUP BY kind, day"


def builtin_query(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own sketches of each type's users by status of the day, merged: exact count, and whether the estimate is within 10 %."""
    rows = events(spark, sf_dir).withColumn("half", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    got = estimate_builtin(merge_builtin(build_builtin(rows, ["kind", "half"], kind=kind), TYPE, kind), TYPE, kind)
    exact = rows.groupBy("kind").agg(F.countDistinct("x").alias("n"))
    return got.join(exact, "kind").select("kind", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


def builtin_sets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the month's first half and of the rest by type: union, intersection and difference are within 15 % of the union."""
    sides, keys = _halves(SPECS["minhash"], spark, sf_dir)
    got = set_sizes_builtin(*(build_builtin(x, keys, kind="theta") for x in sides), keys)
    a, b = (x.select("kind", "x", F.lit(True).alias(s)).distinct() for x, s in zip(sides, "ab"))
    both = a.join(b, ["kind", "x"], "full").groupBy("kind").agg(F.count("*").alias("n_union"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_only"))
    near = lambda c, n: (F.abs(F.col(c) - F.col(n)) <= 0.15 * F.col("n_union"))
    return got.join(both, "kind").select("kind", "n_union", "n_both", "n_only", (near("size_union", "n_union") & near("size_intersection", "n_both") & near("size_difference", "n_only")).alias("close"))


_BUILTIN_SETS = f"""WITH s AS (SELECT kind, x, bool_or(ts < TIMESTAMP '2024-01-16') AS a, bool_or(NOT ts < TIMESTAMP '2024-01-16') AS b FROM ({EVENTS}) WHERE x IS NOT NULL GROUP BY kind, x)
SELECT kind, count(*) AS n_union, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (NOT b) AS n_only, true AS close FROM s GROUP BY kind HAVING bool_or(a) AND bool_or(b)"""


def error_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative error of the estimate against the truth, by flag."""
    got = estimate_query(SPECS["exp"], spark, sf_dir).join(exact_cardinality(spark, sf_dir), "flag")
    return got.select("flag", F.round(F.abs(F.col("estimate") - F.col("total")) / F.col("total"), 9).alias("error"))


def _error_sql() -> str:
    return f"SELECT flag, round(abs(estimate - total) / total, 9) AS error FROM ({Q.estimate_sql(SPECS['exp'], LINES, FLAG)}) JOIN (SELECT flag, sum(w) AS total FROM (SELECT flag, x, max(w) AS w FROM ({LINES}) GROUP BY flag, x) GROUP BY flag) USING (flag)"


def quantize_query(mode: S.QuantizationMode, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in a custom float of five exponent and six mantissa bits."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 7919.0).alias("v"))
    return rows.select("o_orderkey", F.round(quantize(F.col("v"), 5, 6, mode), 9).alias("q"))


def _quantize_sql(mode: S.QuantizationMode) -> str:
    return f"SELECT o_orderkey, round({Q.quantize_sql('v', 5, 6, mode.value)}, 9) AS q FROM (SELECT o_orderkey, o_totalprice / 7919.0::DOUBLE AS v FROM orders)"


def window_query(shape: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the stream, over the table."""
    spec = S.ExpSketch(16)
    window = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "2 days", "1 day"), "session": F.session_window("ts", "30 minutes")}[shape]
    keys = [] if shape == "session" else TYPE
    got = window_sums(window_registers(events(spark, sf_dir), spec, window, keys), spec, keys)
    return rounded(got).select(F.unix_timestamp("window.start").alias("start"), *keys, "estimate")


def _window_sql(shape: str) -> str:
    spec, day = S.ExpSketch(16), "epoch(date_trunc('day', ts))::BIGINT"
    if shape == "session":
        source = f"""SELECT max(CASE WHEN gap THEN t END) OVER (ORDER BY ts, o ROWS UNBOUNDED PRECEDING) AS start, x, w
        FROM (SELECT *, floor(epoch(ts))::BIGINT AS t, coalesce(ts - lag(ts) OVER (ORDER BY ts, o) >= INTERVAL 30 MINUTE, true) AS gap FROM ({WEIGHED}))"""
        keys = ["start"]
    else:
        back = "0" if shape == "tumbling" else "unnest([0, 86400])"
        source, keys = f"SELECT {day} - {back} AS start, kind, x, w FROM ({WEIGHED})", ["start", "kind"]
    return Q.estimate_sql(spec, source, keys)


def memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of registers, seeds and all of each spec."""
    rows = [(n, memory_usage(s, S.MemoryFlag.REGISTERS), memory_usage(s, S.MemoryFlag.SEEDS)) for n, s in SPECS.items()]
    return spark.createDataFrame(rows, "name string, registers long, seeds long")


def _memory_sql() -> str:
    bits = {n: s.amount_bits or (s.exp_bits + s.mant_bits if s.exp_bits else 0) for n, s in SPECS.items()}
    plain = {"double": 8, "float": 4, "int": 1}
    rows = ", ".join(f"('{n}', {f'8 * ceil({s.m} * {bits[n]} / 64.0)' if bits[n] else s.m * plain[s.traits.value]}::BIGINT, 8::BIGINT)" for n, s in SPECS.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(name, registers, seeds)"


def hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portable hash of every part's name, and the uniforms of three registers."""
    with wrapping(spark):
        rows = table(spark, sf_dir, "part").select("p_partkey", element_hash(F.col("p_name"), 42).alias("h"))
        rows = rows.select("p_partkey", "h", F.explode(F.array(*[F.lit(k) for k in (0, 5, 1000)])).alias("i"))
        return rows.select("p_partkey", "h", "i", unit(mixed(F.col("h"), F.col("i"))).alias("u"))


def _hash_sql() -> str:
    ctes = ["p AS (SELECT p_partkey, p_name AS x FROM part)", f"hp AS (SELECT p_partkey, {Q.hash_sql(42)} AS h FROM p)", *Q.mixer_sql("mx", "(SELECT *, unnest([0, 5, 1000]) AS i FROM hp)", "i")]
    return f"WITH {', '.join(ctes)} SELECT p_partkey, h::BIGINT AS h, i, {Q.UNIT} AS u FROM mx"


def generator_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of each distribution: elements, whether all differ, and the sum of the weights."""
    out = None
    for d in generators.DISTRIBUTIONS:
        one = generators.weighted_stream(spark, 1000, 500.0, d, 3).agg(F.lit(d).alias("name"), F.count("*").alias("n"), F.countDistinct("x").alias("elements"), F.round(F.sum("w"), 6).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def jaccard_streams_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact similarity of generated pairs of streams."""
    out = None
    for j in (0.0, 0.3, 0.8, 1.0):
        rows = generators.jaccard_streams(spark, 500, 100.0, j, "exponential", seed=5)
        sides = rows.groupBy("x").pivot("side", ["a", "b"]).agg(F.max("w")).fillna(0.0, ["a", "b"])
        one = sides.agg(F.lit(j).alias("wanted"), F.round(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), 6).alias("jaccard"))
        out = one if out is None else out.unionByName(one)
    return out


_GENERATED = ", ".join(f"('{d}', 1000::BIGINT, 1000::BIGINT, 500.0::DOUBLE)" for d in generators.DISTRIBUTIONS)

QUERIES: dict[str, Query] = {"exact_weighted_cardinality": exact_cardinality, "exact_weighted_jaccard": exact_jaccard}
ORACLE_SQL: dict[str, str] = {
    "exact_weighted_cardinality": f"SELECT flag, sum(w) AS total, count(*) AS n FROM (SELECT flag, x, max(w) AS w FROM ({LINES}) GROUP BY flag, x) GROUP BY flag",
    "exact_weighted_jaccard": EXACT_JACCARD,
}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


for _name, _spec in SPECS.items():
    _, _keys, _sql = _source(_spec)
    _add(f"registers_{_name}", partial(registers_query, _spec), Q.registers_sql(_spec, _sql, _keys))
    _add(f"estimate_{_name}", partial(estimate_query, _spec), Q.estimate_sql(_spec, _sql, _keys))
    if _spec.has_jaccard:
        _add(f"jaccard_{_name}", partial(jaccard_query, _spec), _jaccard_sql(_spec))
    _add(f"merge_{_name}", partial(merge_query, _spec), Q.registers_sql(_spec, _sql, _keys))
for _name in ("exp", "weighted_hll", "kqsketch_shifted"):
    _add(f"rollup_{_name}", partial(rollup_query, SPECS[_name]), Q.estimate_sql(SPECS[_name], LINES, ["status"]))
for _name in ("exp", "exp_float32", "fast_exp_custom_float", "logexp_fast_noshift", "logexp_slow_shifted", "qsketch", "kqsketch_shifted", "weighted_hll", "hll"):
    _spec = SPECS[_name]
    _add(f"state_{_name}", partial(state_query, _spec), Q.registers_sql(_spec, _source(_spec)[2], _source(_spec)[1]))
for _name in ("kqsketch", "kqsketch_rounding", "kqsketch_shifted"):
    _add(f"direct_{_name}", partial(direct_query, SPECS[_name]), _direct_sql(SPECS[_name]))
for _name in ("kqsketch", "kqsketch_shifted"):
    for _start in ("cold", "warm"):
        _add(f"newton_{_start}_{_name}", partial(newton_query, SPECS[_name], _start), _newton_sql(SPECS[_name], _start))
_add("corrected_kqsketch_rounding", corrected_query, _corrected_sql())
_add("cube_exp", cube_query, _cube_sql())
_add("clone_with", clone_query, Q.registers_sql(SPECS["fast_exp_custom_float"].with_(exp_bits=7, mant_bits=5), LINES, FLAG))
for _name, _of in (("dense_registers", "kqsketch_shifted"), ("dense_logexp_slow_shifted", "logexp_slow_shifted"), ("dense_logexp_fast_shifted", "logexp_fast_shifted")):
    _add(_name, partial(dense_query, _of), _dense_sql(_of))
_add("martingale_minhash", martingale_query, Q.martingale_sql(MARTINGALE, EVENTS, TYPE))
_add("qsketch_dyn", partial(dyn_query, QDYN, False), Q.dyn_sql(QDYN, WEIGHED, TYPE))
_add("qsketch_dyn_post_update", partial(dyn_query, QDYN, True), Q.dyn_sql(QDYN, WEIGHED, TYPE, True))
_add("qsketch_dyn_gseed", partial(dyn_query, QDYN.with_(g_seed=7), False), Q.dyn_sql(QDYN.with_(g_seed=7), WEIGHED, TYPE))
_add("direct_kqsketch_rounded_dyn", partial(dyn_verb_query, "direct"), Q.dyn_sql(KQDYN, WEIGHED, TYPE))
_add("newton_kqsketch_rounded_dyn", partial(dyn_verb_query, "newton"), f"SELECT *, 0::INTEGER AS iterations FROM ({Q.dyn_sql(KQDYN, WEIGHED, TYPE)})")
_add("jaccard_null_key", null_key_query, _null_key_sql())
_add("several_sketches", many_query, _many_sql())
_add("all_pairs_similarity", all_pairs_query, _all_pairs_sql())
_add("set_sizes", set_sizes_query, _set_sizes_sql())
_add("moving_union", moving_union_query, _moving_union_sql())
for _name in ("hll", "theta"):
    _add(f"builtin_{_name}", partial(builtin_query, _name), f"SELECT kind, count(DISTINCT x) AS n, true AS close FROM ({EVENTS}) GROUP BY kind")
_add("builtin_theta_sets", builtin_sets_query, _BUILTIN_SETS)
_add("relative_error", error_query, _error_sql())
_add("kqsketch_rounded_dyn", partial(dyn_query, KQDYN, False), Q.dyn_sql(KQDYN, WEIGHED, TYPE))
for _mode in S.QuantizationMode:
    _add(f"quantize_{_mode.value.lower()}", partial(quantize_query, _mode), _quantize_sql(_mode))
for _shape in ("tumbling", "sliding", "session"):
    _add(f"window_{_shape}_exp", partial(window_query, _shape), _window_sql(_shape))
_add("memory_usage", memory_query, _memory_sql())
_add("portable_hash", hash_query, _hash_sql())
_add("generated_streams", generator_query, f"SELECT * FROM (VALUES {_GENERATED}) AS t(name, n, elements, total)")
_add("generated_jaccard", jaccard_streams_query, "SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.3, 0.3), (0.8, 0.8), (1.0, 1.0)) AS t(wanted, jaccard)")
