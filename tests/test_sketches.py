"""The contract of all sketches, over one stream with groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallybook as tb
from tallybook.functions.hashing import wrapping
from tallybook.operators import registers as registers_
from tallybook.operators.ordered import DynState, build_ordered, dyn, records
from tallybook.operators.registers import bucket_columns, register_value
from tallybook.sources import generators

M400 = {
    "ExpSketch": (tb.ExpSketch(400), 0.15), "ExpSketchFloat32": (tb.ExpSketchFloat32(400), 0.15), "FastExpSketch": (tb.FastExpSketch(400), 0.15),
    "FastExpSketchFloat32": (tb.FastExpSketchFloat32(400), 0.15), "FastGMExpSketch": (tb.FastGMExpSketch(400), 0.15),
    "FastExpSketchCustomFloat": (tb.FastExpSketchCustomFloat(400, 42, 8, 10), 0.15), "LogExpSketchSlowNoShifted": (tb.LogExpSketchSlowNoShifted(400, 42, 12, 1e6), 0.15),
    "LogExpSketchFastNoShifted": (tb.LogExpSketchFastNoShifted(400, 42, 12, 1e6), 0.15), "LogExpSketchSlowShifted": (tb.LogExpSketchSlowShifted(400, 42, 12, 1e6), 0.15),
    "LogExpSketchFastShifted": (tb.LogExpSketchFastShifted(400, 42, 12, 1e6), 0.15), "QSketch": (tb.QSketch(400, 42, 8), 0.15), "kQSketch": (tb.kQSketch(400, 42, 10, 1.5), 0.15),
    "kQSketchRounding": (tb.kQSketchRounding(400, 42, 10, 1.1), 0.15), "kQSketchShifted": (tb.kQSketchShifted(400, 42, 6, 1.5), 0.15),
    "WeightedMinHash": (tb.WeightedMinHash(400), 0.15), "WeightedHyperLogLog": (tb.WeightedHyperLogLog(50), 0.6), "WeightedHyperLogLogFloat32": (tb.WeightedHyperLogLogFloat32(50), 0.6),
    "WeightedHyperLogLogCustomFloat": (tb.WeightedHyperLogLogCustomFloat(50, 42, 8, 10), 0.6), "MinHash": (tb.MinHash(400), 0.15), "HyperLogLog": (tb.HyperLogLog(400), 0.12),
}
MERGEABLE = sorted(M400)


@pytest.fixture(scope="module")
def rows(spark):
    one = generators.weighted_stream(spark, 500, 5e4, "exponential", 7).withColumn("g", F.lit("big"))
    two = generators.weighted_stream(spark, 500, 1e4, "uniform", 9).withColumn("g", F.lit("even"))
    return one.unionByName(two).repartition(4).cache()


def sketched(spec, df, keys=("g",), **options):
    return tb.build(df, spec, list(keys), "x", "w", **options)


def as_dict(registers, *keys):
    return {tuple(r[k] for k in (*keys, "i")): r.r for r in registers.collect()}


def close(a, b, value):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k] if value == "int" else a[k] == pytest.approx(b[k], rel=1e-6 if value == "float" else 1e-11)


def test_registry():
    assert set(M400) | {"MartingaleMinHash", "QSketchDyn", "kQSketchRoundedDyn"} == set(tb.KINDS) and len(tb.KINDS) == 23


@pytest.mark.parametrize("kind", MERGEABLE)
def test_accuracy(rows, kind):
    spec, tolerance = M400[kind]
    got = {r.g: r.estimate for r in tb.estimate(sketched(spec, rows), spec, ["g"]).collect()}
    for g, total in (("big", 5e4), ("even", 1e4)):
        assert got[g] == pytest.approx(total if spec.is_weighted else 500, rel=tolerance)


@pytest.mark.parametrize("kind", MERGEABLE)
def test_both_methods_repetition_and_order(rows, kind):
    spec = M400[kind][0].with_(m=24)
    want = as_dict(sketched(spec, rows, method="relational"), "g")
    close(as_dict(sketched(spec, rows, method="arrow"), "g"), want, spec.traits.value)
    lighter = rows.withColumn("w", F.col("w") * 0.5)
    again = rows.unionByName(lighter).unionByName(rows).orderBy("x")  # an element counts once, with its greatest weight
    close(as_dict(sketched(spec, again), "g"), want, spec.traits.value)
    close(as_dict(sketched(spec, again, dedup=False), "g"), want, spec.traits.value)
    assert {k[1] for k in want} <= set(range(24))
    if spec.traits.family != "bucket":
        assert len(want) == 48


@pytest.mark.parametrize("kind", MERGEABLE)
def test_merge_and_rollup(rows, kind):
    spec = M400[kind][0].with_(m=16)
    parts = [rows.where(F.crc32("x") % 3 == k) for k in range(3)]
    a, b, c = ((sketched(spec, p), spec) for p in parts)
    whole = as_dict(sketched(spec, rows), "g")
    left = (tb.merge([a, b], ["g"]), spec)
    assert as_dict(tb.merge([left, c], ["g"]), "g") == as_dict(tb.merge([a, b, c], ["g"]), "g") == as_dict(tb.merge([c, b, a], ["g"]), "g")
    close(as_dict(tb.merge([a, b, c], ["g"]), "g"), whole, spec.traits.value)
    assert as_dict(tb.merge([a, a], ["g"]), "g") == as_dict(a[0], "g")
    close(as_dict(tb.rollup(sketched(spec, rows), spec)), as_dict(sketched(spec, rows, keys=())), spec.traits.value)
    for other in (spec.with_(m=17), spec.with_(seed=1)):
        with pytest.raises(ValueError):
            tb.merge([a, (a[0], other)], ["g"])


@pytest.mark.parametrize("kind", [k for k in MERGEABLE if M400[k][0].has_jaccard])
def test_jaccard(spark, kind):
    spec = M400[kind][0].with_(m=200)
    for similarity in (0.0, 0.3, 0.8, 1.0):
        pair = generators.jaccard_streams(spark, 300, 1000.0, similarity, "uniform", seed=3)
        a, b = (tb.build(pair.where(F.col("side") == s), spec, (), "x", "w") for s in "ab")
        got = tb.jaccard(a, b, spec).first()[0]
        assert got == pytest.approx(similarity if spec.is_weighted or similarity in (0, 1) else got, abs=0.15)
        if similarity == 1:
            assert got == 1
    with pytest.raises(ValueError):
        tb.jaccard(a, b, spec, spec.with_(seed=3))


def test_capabilities():
    assert not tb.QSketch(8, 1, 8).has_jaccard and not tb.MartingaleMinHash(8).is_mergeable and not tb.MinHash(8).is_weighted and tb.kQSketch(8, 1, 8, 2.0).has_newton


@pytest.mark.parametrize("bad", [
    lambda: tb.ExpSketch(0), lambda: tb.ExpSketch(-1), lambda: tb.QSketch(8, 1, 1), lambda: tb.QSketch(8, 1), lambda: tb.kQSketch(8, 1, 8, 1.0), lambda: tb.LogExpSketchSlowShifted(8, 1, 8, 1.0),
    lambda: tb.FastExpSketchCustomFloat(8, 1, 0, 3), lambda: tb.SketchSpec("Nothing", 8), lambda: tb.ExpSketch(8, 1 << 64), lambda: tb.ExpSketch(8, 1, 2),
])
def test_bad_specs(bad):
    with pytest.raises((ValueError, TypeError)):
        bad()


@pytest.mark.parametrize("w", [0.0, -1.0, math.nan, math.inf])
def test_bad_weights(spark, w):
    spec = tb.ExpSketch(4)
    df = spark.createDataFrame([("a", 1.0), ("b", w)], "x string, w double")
    with pytest.raises(Exception, match="weight must be finite and positive"):
        tb.build(df, spec).collect()
    assert tb.build(df, spec, on_invalid="drop").count() == 4


@pytest.mark.parametrize("kind", MERGEABLE)
def test_nulls_empty_string_and_no_rows(spark, kind):
    spec = M400[kind][0].with_(m=1)
    df = spark.createDataFrame([("", 2.0), (None, 1.0), ("a", None)], "x string, w double")
    assert sorted(as_dict(tb.build(df, spec, (), "x", "w"))) == [(0,)]
    assert tb.build(df.limit(0), spec, (), "x", "w").count() == 0
    none = tb.estimate(tb.build(df.limit(0), spec, (), "x", "w"), spec).collect()
    assert [r.estimate for r in none] in ([0.0], [])


def test_newton(rows):
    for spec in (tb.kQSketch(200, 42, 10, 1.5), tb.kQSketchShifted(200, 42, 6, 1.5)):
        registers = sketched(spec, rows)
        cold, warm, plain = ({r.g: r for r in tb.newton(registers, spec, ["g"], s).collect()} for s in ("cold", "warm", "default"))
        direct = {r.g: r.estimate for r in tb.estimate_direct(registers, spec, ["g"]).collect()}
        for g in direct:
            assert warm[g].estimate == pytest.approx(direct[g], rel=0.02)
            assert cold[g].estimate == pytest.approx(warm[g].estimate, rel=1e-6) == plain[g].estimate
            assert 0 < warm[g].iterations <= cold[g].iterations
    with pytest.raises(ValueError):
        tb.newton(registers, tb.ExpSketch(200))
    spec = tb.kQSketchRounding(200, 42, 10, 2.0)
    registers = sketched(spec, rows)
    ratio = tb.estimate_corrected(registers, spec, ["g"]).first().estimate / tb.estimate(registers, spec, ["g"]).first().estimate
    assert ratio == pytest.approx(2 * math.sinh(math.log(2) / 2) / math.log(2))


def test_clone_is_a_fresh_coarse_sketch(rows):
    fine = tb.FastExpSketchCustomFloat(64, 42, 7, 7)
    got, coarse = tb.clone_with(sketched(fine, rows), fine, 6, 5)
    close(as_dict(got, "g"), as_dict(sketched(coarse, rows), "g"), "double")
    for bits in ((8, 5), (6, 8)):
        with pytest.raises(ValueError):
            tb.clone_with(got, fine, *bits)


@pytest.mark.parametrize("scale", [1e-6, 1e-3, 1.0, 1e4])
@pytest.mark.parametrize("kind", ["LogExpSketchSlowShifted", "LogExpSketchFastShifted", "kQSketchShifted", "ExpSketch", "QSketch"])
def test_small_and_large_weights(rows, kind, scale):
    """Shifted windows follow the registers wherever they are, and an empty sketch changes nothing in a merge."""
    spec = M400[kind][0]
    scaled = rows.withColumn("w", F.col("w") * scale)
    registers = sketched(spec, scaled)
    both = tb.merge([(registers, spec), (sketched(spec, scaled.limit(0)), spec)], ["g"])
    assert as_dict(both, "g") == as_dict(registers, "g")
    got = {r.g: r.estimate for r in tb.estimate(both, spec, ["g"]).collect()}
    assert got["big"] == pytest.approx(5e4 * scale, rel=0.15)


@pytest.mark.parametrize("kind", MERGEABLE)
def test_store(tmp_path, rows, kind):
    spec = M400[kind][0].with_(m=24, rng_engine=tb.RngEngine.PCG64)
    registers = sketched(spec, rows)
    tb.save(registers, spec, str(tmp_path / "s"), ["g"])
    got, known = tb.load(rows.sparkSession, str(tmp_path / "s"), ["g"])
    assert known == spec and as_dict(got, "g") == as_dict(registers, "g")
    with pytest.raises(Exception, match="other parameters"):
        tb.from_state(tb.to_state(registers, spec, ["g"]), spec.with_(seed=9), ["g"]).collect()


def test_murmur_sketches(rows):
    for spec in (tb.ExpSketch(200, hash="murmur3"), tb.FastExpSketch(200, hash="murmur3"), tb.kQSketch(200, 42, 10, 1.5, hash="murmur3"), tb.ExpSketch(200, hash="xx")):
        got = {r.g: r.estimate for r in tb.estimate(sketched(spec, rows), spec, ["g"]).collect()}
        assert got["big"] == pytest.approx(5e4, rel=0.25) and got["even"] == pytest.approx(1e4, rel=0.25)


# sequential sketches


def walk(spec, stream):
    """Row by row, with every repetition."""
    from tallybook.functions.hashing import mixed_np, unit_np
    from tallybook.operators.registers import register_value_np
    import hashlib

    state, e, held = DynState(spec) if spec.kind != "MartingaleMinHash" else None, 0.0, np.full(spec.m, np.inf)
    for x, w in stream:
        h = np.array([int(hashlib.md5(f"{spec.seed}:{x}".encode()).hexdigest()[:15], 16)], np.uint64)
        if state:
            i = int(mixed_np(h, np.array([2 * spec.m]))[0, 0] >> np.uint64(12)) % spec.m
            g = -np.log(unit_np(mixed_np(h, np.array([2 * spec.m + 1])))) / w
            state.change(i, int(register_value_np(spec, g)[0, 0]), w)
        else:
            g = -np.log(unit_np(mixed_np(h, np.arange(spec.m)))[0])
            p = 1 - math.exp(-held.sum()) if np.isfinite(held).all() else 1.0
            e += (g < held).any() / p
            held = np.minimum(held, g)
    return state.cardinality if state else e


@pytest.mark.parametrize("spec", [tb.MartingaleMinHash(64), tb.QSketchDyn(200, 42, 8), tb.kQSketchRoundedDyn(200, 42, 8, 1.5)], ids=lambda s: s.kind)
def test_sequential_sketches(spark, spec):
    rng = np.random.default_rng(3)
    stream = [(f"e{rng.integers(400)}", float(rng.uniform(0.5, 3))) for _ in range(1200)]
    df = spark.createDataFrame([(k, x, w, "a") for k, (x, w) in enumerate(stream)], "seq long, x string, w double, g string").repartition(5)
    got = build_ordered(df, spec, ["g"]).first().estimate
    assert got == pytest.approx(walk(spec, stream), rel=1e-9)
    first = dict(reversed(stream))
    single = spark.createDataFrame([(k, x, w) for k, (x, w) in enumerate(first.items())], "seq long, x string, w double")
    assert build_ordered(single, spec).first().estimate == pytest.approx(sum(first.values()) if spec.is_weighted else len(first), rel=0.25)
    assert build_ordered(df.limit(0), spec, ["g"]).count() == 0
    with pytest.raises(ValueError):
        tb.build(df, spec)
    if spec.is_weighted:
        changes = records(df, spec, ["g"])
        assert dyn(changes, spec, ["g"], post_update=True).first().estimate > got
        assert sum(DynState(spec, registers=dyn(changes, spec, ["g"]).first().registers).histogram()) == spec.m


# sizes and generators


def test_memory_flags():
    F_ = tb.MemoryFlag
    for kind, (spec, _) in M400.items():
        use = lambda f, s=spec: tb.memory_usage(s, f)
        assert use(F_.NOTHING) == 0 and use(F_.SEEDS) == 8
        parts = [F_.REGISTERS, F_.ALL_WRITE_NO_REGISTERS, F_.FISHER_YATES_PERM_INIT, F_.FISHER_YATES_NON_PERM_INIT, F_.SEEDS]
        assert sum(map(use, parts)) == use(F_.TOTAL)
        assert use(F_.TOTAL | F_.REGISTERS) == use(F_.TOTAL) - use(F_.REGISTERS)
        assert tb.memory_usage(spec.with_(m=800), F_.REGISTERS) > use(F_.REGISTERS)
    assert tb.memory_usage(tb.ExpSketch(400), F_.REGISTERS) == 3200 and tb.memory_usage(tb.QSketch(400, 1, 6), F_.REGISTERS) == 304


@pytest.mark.parametrize("distribution", generators.DISTRIBUTIONS)
def test_generators(spark, distribution):
    rows = generators.weighted_stream(spark, 300, 123.0, distribution, 4).collect()
    assert len({r.x for r in rows}) == 300 and sum(r.w for r in rows) == pytest.approx(123.0) and min(r.w for r in rows) > 0
    for j in (0.0, 0.2, 0.9, 1.0):
        pair = generators.jaccard_streams(spark, 100, 50.0, j, distribution, placement=generators.Placement.LAST, seed=2).collect()
        a, b = ({r.x: r.w for r in pair if r.side == s} for s in "ab")
        assert len(a) == len(b) == 100 and sum(a.values()) == pytest.approx(50) == sum(b.values())
        least = sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})
        assert least / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) == pytest.approx(j, abs=1e-6)


def test_generator_errors_and_measures(spark):
    with pytest.raises(ValueError):
        generators.weighted_stream(spark, 10, 1.0, "nothing")
    assert len(generators.make_seeds(20, 1)) == 20 and generators.jaccard_variance(0.5, 100) == 0.0025
    df = spark.createDataFrame([(90.0,), (math.nan,), (math.inf,), (-1.0,), (1e9,)], "e double")
    got = [r[0] for r in df.select(generators.safe_relative_error(F.col("e"), F.lit(100.0))).collect()]
    assert got == [pytest.approx(0.1), 10, 10, 10, 10]
    rse = generators.experiment(spark, lambda m: tb.ExpSketch(m), [32, 64], 50, 10.0, 60, "zipf").collect()
    assert [r.m for r in rse] == [32, 64] and all(0.4 < r.rse * math.sqrt(r.m - 2) < 1.8 for r in rse)


def test_keys_may_have_any_name(spark):
    rows = generators.weighted_stream(spark, 60, 100.0, "uniform", 4).withColumn("seq", F.col("pos"))
    spec, dyn_spec = tb.ExpSketch(8), tb.QSketchDyn(8, 42, 8)
    key = F.when(F.col("pos") % 3 > 0, F.col("pos") % 3)  # null, 1, 2
    plain = rows.withColumn("k", key)
    want = as_dict(tb.build(plain, spec, ["k"]), "k")
    estimates = {r.k: r.estimate for r in tb.estimate(tb.build(plain, spec, ["k"]), spec, ["k"]).collect()}
    ordered = {r.k: r.estimate for r in tb.build_ordered(plain, dyn_spec, ["k"]).collect()}
    assert len(estimates) == len(ordered) == 3
    for name in ("_h", "_x", "_w", "_g", "_s", "_n", "_k", "_o", "_ra", "a.b", "a`b", "_key0_", "before"):
        for method in ("relational", "arrow"):
            got = tb.build(rows.withColumn(name, key), spec, [name], method=method)
            assert got.columns == [name, "i", "r"]
            assert {(k, i): r for k, i, r in map(tuple, got.collect())} == pytest.approx(want)
        assert dict(map(tuple, tb.estimate(got, spec, [name]).collect())) == pytest.approx(estimates)
        assert set(map(tuple, tb.jaccard(got, got, spec, keys=[name]).collect())) == {(k, 1.0) for k in estimates}
        assert dict(map(tuple, tb.build_ordered(rows.withColumn(name, key), dyn_spec, [name]).collect())) == pytest.approx(ordered)
        assert tb.merge([(got, spec), (got, spec)], [name]).count() == tb.rollup(got, spec, [name]).count() == len(want)
    for name in ("i", "r"):
        with pytest.raises(ValueError):
            tb.build(rows.withColumn(name, key), spec, [name])


def test_jaccard_of_null_and_one_sided_keys(spark):
    spec = tb.ExpSketch(16)
    a = tb.build(spark.createDataFrame([(None, "x", 1.0), ("p", "x", 1.0), ("q", "x", 1.0)], "k string, x string, w double"), spec, ["k"])
    b = tb.build(spark.createDataFrame([(None, "x", 1.0), ("q", "y", 1.0), ("z", "y", 1.0)], "k string, x string, w double"), spec, ["k"])
    got = dict(map(tuple, tb.jaccard(a, b, spec, keys=["k"]).collect()))
    assert got == {None: 1.0, "p": 0.0, "q": 0.0, "z": 0.0}
    assert tb.jaccard(a.limit(0), b.limit(0), spec, keys=["k"]).count() == 0
    assert tb.jaccard(a.limit(0), b.limit(0), spec).first()[0] == 1.0  # two empty sketches
    sizes = {r.k: r for r in tb.set_sizes(a, b, spec, ["k"]).collect()}
    assert sizes[None].size_difference == 0 and sizes["p"].size_b == 0 and sizes["p"].size_difference == sizes["p"].size_a == sizes["p"].size_union
    assert tb.all_pairs(a, spec, "k").collect() == [("p", "q", 1.0)]


def test_ordered_sketches_deal_out_few_rows(spark):
    from tallybook.operators import ordered

    n = 20_000
    rows = generators.weighted_stream(spark, n, 1e4, "uniform", 3).withColumnRenamed("pos", "seq").repartition(4).cache()
    seen = []
    own = ordered.own_records
    try:
        ordered.own_records = lambda *a: seen.append(own(*a)) or seen[-1]
        for spec, weight in ((tb.MartingaleMinHash(32), None), (tb.QSketchDyn(32, 42, 8), "w"), (tb.kQSketchRoundedDyn(32, 42, 8, 1.5), "w")):
            whole = {(r._o, r.i): r.r for r in records(rows, spec, (), "x", weight).collect()}
            few = seen[-1].count()
            batches = -(-n // 4 // 10_000) * 4
            assert len(whole) <= few <= 4 * batches * 32 * (1 + math.log(n)) < n * (32 if weight is None else 1)
            # the same records as without tasks that leave rows out
            every = {}
            for r in sorted(seen[-1].collect(), key=lambda r: (r._o, r._x)):
                held = every.setdefault(r.i, [])
                if not held or (r.r < held[-1][1] if weight is None else r.r > held[-1][1]):
                    held.append((r._o, r.r))
            assert whole == {(o, i): r for i, x in every.items() for o, r in x}
    finally:
        ordered.own_records = own


def test_records_match_a_loop(spark):
    spec = tb.QSketchDyn(4, 42, 8)
    rows = generators.weighted_stream(spark, 500, 300.0, "exponential", 8).withColumn("seq", F.col("pos") % 50).repartition(3)
    got = sorted((r._o, r._x, r.i, r.r, r.before) for r in records(rows, spec).collect())
    with wrapping(spark):
        one = bucket_columns(rows.select("seq", F.col("x").alias("_x"), F.col("w").alias("_w")), spec, [], "seq", "_x")
        one = one.select("seq", "_x", "_w", "i", register_value(spec, F.col("_g")).alias("r"))
    held, want = {}, []
    for r in sorted(one.collect(), key=lambda r: (r.seq, r._x, r._w)):
        before = held.get(r.i, spec.r_min)
        if r.r > before:
            want.append((r.seq, r._x, r.i, r.r, before))
            held[r.i] = r.r
    assert got == sorted(want)


def test_g_seed_chooses_other_registers(rows):
    one, two = (tb.QSketchDyn(16, 42, 8, g_seed=s) for s in (42, 7))
    a, b = (build_ordered(rows, s, ["g"], order="x").collect() for s in (one, two))
    assert {r.estimate for r in a}.isdisjoint({r.estimate for r in b})
    with pytest.raises(ValueError):
        tb.QSketchDyn(16, 42, 8, g_seed=-1)


def test_rounded_dyn_verbs_need_the_running_value(rows):
    spec = tb.kQSketchRoundedDyn(200, 42, 8, 1.5)
    changes = records(rows, spec, ["g"], order="x")
    state = dyn(changes, spec, ["g"])
    running = {r.g: r.estimate for r in state.collect()}
    assert running["even"] == pytest.approx(1e4, rel=0.3)
    assert {r.g: r.estimate for r in tb.estimate_direct(state, spec, ["g"]).collect()} == running
    assert {(r.g, r.iterations): r.estimate for r in tb.newton(state, spec, ["g"], "warm").collect()} == {(g, 0): e for g, e in running.items()}
    for verb in (tb.estimate, tb.estimate_direct, tb.newton):
        with pytest.raises(ValueError):
            verb(tb.last_registers(changes, spec, ["g"]), spec, ["g"])


@pytest.mark.parametrize("hash_", ["portable", "xx"])
def test_several_sketches_in_one_pass(rows, hash_):
    specs = {k: s.with_(m=24, hash=hash_) for k, (s, _) in M400.items()}
    many = tb.build_many(rows, specs, ["g"]).cache()
    for kind, spec in specs.items():
        close(as_dict(tb.one_of(many, kind, spec, ["g"]), "g"), as_dict(sketched(spec, rows), "g"), spec.traits.value)
    for bad in ({}, {"a": tb.ExpSketch(4), "b": tb.ExpSketch(4, 1)}, {"a": tb.QSketchDyn(4, 42, 8)}):
        with pytest.raises(ValueError):
            tb.build_many(rows, bad, ["g"])
    assert tb.build_many(rows.limit(0), specs).count() == 0


def test_several_sketches_leave_out_what_changes_nothing(monkeypatch):
    """Of a long stream few elements get exponentials; the registers are those of all of them."""
    specs = [s.with_(m=m) for m in (8, 24) for s, _ in M400.values() if s.traits.family != "bucket"]
    rng, n, known = np.random.default_rng(5), 40_000, [("a",), (None,), ("b",)]
    h, w, group = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(1, 50, n).astype(float), rng.integers(0, 3, n)
    sent, plain = [], registers_.block_exponentials
    monkeypatch.setattr(registers_, "block_exponentials", lambda spec, h, *more: sent.append(len(h)) or plain(spec, h, *more))
    held = registers_.ManyHeld(specs)
    for at in range(0, n, held.step):
        part = slice(at, at + held.step)
        held.add(known[::-1], 2 - group[part], h[part], w[part])
    assert sum(sent) < 0.4 * n * len(held.forms) and len(held.forms) < len(specs) / 2
    for spec in specs:
        made = plain(spec, h, None, w if spec.is_weighted else np.ones(n))
        best = np.max if spec.kind == "WeightedMinHash" else np.min
        want = np.array([best(made[group == g], axis=0) for g in range(3)])
        got = held.registers(spec)[[held.slots[k] for k in known]]
        np.testing.assert_allclose(got, want if spec.kind == "WeightedMinHash" else registers_.register_value_np(spec, want), rtol=1e-12)


def test_several_sketches_of_many_keys(spark):
    """Null keys, keys that are equal but not the same, empty registers, and more keys than a task holds."""
    key = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, F.lit(-0.0)).when(F.col("id") % 7 == 2, F.lit(0.0)).otherwise((F.col("id") % 300).cast("double"))
    df = spark.range(0, 9000, 1, 2).select(key.alias("k"), (F.col("id") % 4000).alias("x"), (F.col("id") % 5 + 0.5).alias("w"))
    specs = {"s": tb.kQSketchShifted(8, 42, 3, 1.2), "p": tb.WeightedMinHash(8), "c": tb.WeightedHyperLogLogCustomFloat(16, 42, 8, 10), "h": tb.HyperLogLog(16)}
    many = tb.build_many(df, specs, ["k"]).cache()
    for name, spec in specs.items():
        want = as_dict(tb.build(df, spec, ["k"]), "k")
        close(as_dict(many.where(F.col("sketch") == name), "k"), want, spec.traits.value)
    wide = spark.range(0, 6000, 1, 1).select(F.col("id").alias("k"), F.col("id").alias("x"))
    assert registers_.ManyHeld([tb.HyperLogLog(1024)]).each * 6000 > registers_._BYTES_HELD
    got, want = tb.build_many(wide, {"h": tb.HyperLogLog(1024)}, "k", w=None).drop("sketch"), tb.build(wide, tb.HyperLogLog(1024), "k", w=None)
    assert as_dict(got, "k") == as_dict(want, "k")


def test_custom_floats_are_stored_in_their_bits(rows):
    for spec in (tb.FastExpSketchCustomFloat(64, 42, 8, 7), tb.WeightedHyperLogLogCustomFloat(500, 42, 5, 3)):
        registers = sketched(spec, rows)
        state = tb.to_state(registers, spec, ["g"])
        assert {len(r.registers) for r in state.collect()} == {(spec.m * (spec.exp_bits + spec.mant_bits) + 7) // 8}
        most = max(r.r for r in registers.collect())
        want = {k: v for k, v in as_dict(registers, "g").items() if v < most or spec.m == 64}
        got = as_dict(tb.from_state(state, spec, ["g"]), "g")
        assert {k: got.get(k) for k in want} == want


def test_moving_union_is_the_union_of_the_range(spark):
    spec = tb.HyperLogLog(16)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"x{rng.integers(40)}", int(t), None if t % 2 else "k") for t in rng.integers(0, 12, 80)], "x string, t long, k string")
    daily = tb.build(df, spec, ["k", "t"], "x", None)
    got = {}
    for r in tb.moving_union(daily, spec, ["k"], "t", 3).collect():
        got.setdefault((r.k, r.t), {})[r.i] = r.r
    times = {(r.k, r.t) for r in df.collect()}
    for k, t in times:
        some = df.where(F.col("k").eqNullSafe(F.lit(k)) & F.col("t").between(t - 3, t))
        assert got[k, t] == {r.i: r.r for r in tb.build(some, spec, (), "x", None).collect()}
    assert got.keys() == times
    whole = tb.moving_union(tb.build(df, spec, ["t"], "x", None), spec, (), "t", 100)
    last = max(t for _, t in times)
    assert {r.i: r.r for r in whole.where(F.col("t") == last).collect()} == {r.i: r.r for r in tb.build(df, spec, (), "x", None).collect()}
