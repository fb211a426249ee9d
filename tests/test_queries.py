"""Every query against its SQL, and streams against tables."""

import math

import pytest
from pyspark.sql import functions as F

import tallybook as tb
from tallybook.operators.registers import build
from tallybook.plans.queries import ORACLE_SQL, QUERIES, events
from tallybook.streaming.windows import dyn_stream, window_registers, window_sums


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is b or (a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert len(rows) == len(want) > 0
    for a, b in zip(sorted(rows, key=str), sorted(want, key=str)):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["flag", "estimate"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_reads_only_what_it_needs(spark, sf_dir):
    plan = QUERIES["estimate_exp"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan and "Python" not in plan and "partial_max" in plan and "partial_min" in plan


def test_several_sketches_are_one_pass(spark, sf_dir):
    plan = QUERIES["several_sketches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("FileScan parquet") == 1


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    """The events in three files, in order of time."""
    rows = events(spark, sf_dir).orderBy("ts").collect()
    step = -(-len(rows) // 3)
    for k in range(3):
        spark.createDataFrame(rows[k * step : (k + 1) * step], events(spark, sf_dir).schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


@pytest.mark.parametrize("spec", [tb.ExpSketch(8), tb.HyperLogLog(16), tb.WeightedHyperLogLog(16)], ids=lambda s: s.kind)
@pytest.mark.parametrize("shape", ["tumbling", "sliding"])
def test_stream_registers_are_the_tables(spark, sf_dir, stream, tmp_path, spec, shape):
    window = F.window("ts", "5 days") if shape == "tumbling" else F.window("ts", "10 days", "5 days")
    live = window_registers(stream(), spec, window, ["kind"], delay="60 days")
    got = run(spark, live, f"s_{spec.kind}_{shape}", "complete", tmp_path)
    want = window_registers(events(spark, sf_dir), spec, window, ["kind"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_session_registers_on_a_stream(spark, sf_dir, stream, tmp_path):
    """Closed sessions only, as a stream gives them; those are the table's."""
    spec = tb.ExpSketch(4)
    live = window_registers(stream(), spec, F.session_window("ts", "2 hours"), ["kind"], delay="1 minute")
    got = run(spark, live, "sessions", "append", tmp_path).collect()
    want = set(map(str, window_registers(events(spark, sf_dir), spec, F.session_window("ts", "2 hours"), ["kind"]).collect()))
    assert len(got) > 10 and set(map(str, got)) <= want


def test_stream_estimates_in_one_query(spark, stream, tmp_path):
    spec = tb.ExpSketch(8)
    live = window_sums(window_registers(stream(), spec, F.window("ts", "1 day"), ["kind"], delay="1 minute"), spec, ["kind"])
    assert run(spark, live, "sums", "append", tmp_path).where("estimate > 0").count() > 10


@pytest.mark.parametrize("spec", [tb.QSketchDyn(32, 42, 8), tb.kQSketchRoundedDyn(32, 42, 8, 1.5)], ids=lambda s: s.kind)
def test_dyn_stream(spark, sf_dir, tmp_path, spec):
    rows = events(spark, sf_dir)
    step = rows.count() // 3 + 1
    for k in range(3):
        rows.where((F.col("o") >= k * step) & (F.col("o") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    got = {r.kind: r.estimate for r in run(spark, dyn_stream(live, spec, "kind", "x", "w", "o"), f"dyn_{spec.kind}", "update", tmp_path).collect()}
    want = {r.kind: r.estimate for r in tb.build_ordered(rows, spec, ["kind"], "x", "w", "o").collect()}
    assert got == pytest.approx(want)


def test_unfit_kinds_are_refused(spark, sf_dir):
    rows = events(spark, sf_dir)
    with pytest.raises(ValueError):
        window_registers(rows, tb.FastExpSketch(8), F.window("ts", "1 day"))
    with pytest.raises(ValueError):
        dyn_stream(rows, tb.ExpSketch(8), "kind")
    with pytest.raises(ValueError):
        build(rows, tb.ExpSketch(8), method="other")
