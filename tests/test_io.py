"""Sources, sinks, the log, and row-wise operators on a stream."""

from pyspark.sql import functions as F

from tabstat.operators.columns import columns_of, present_groups
from tabstat.operators.describe import describe, frequencies
from tabstat.sources import audit, sinks
from tabstat.sources.tables import overview, scan
from tabstat.streaming.rowwise import apply_rowwise, frozen_fences

SF = "/root/testdata/sf0.001"


def test_csv_keeps_values_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", 0.5, True), (2, None, None, False), (3, 'say "x"', float("nan"), None)], "k bigint, t string, x double, b boolean")
    path = sinks.write_table(df, str(tmp_path / "t"), "csv")
    back = scan(spark, path, "csv", df.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, "a, b", 0.5, True), (2, None, None, False), (3, 'say "x"', None, None)]


def test_columnar_filters_reach_the_scan(spark):
    df = scan(spark, f"{SF}/orders.parquet").where("o_totalprice > 100000").select("o_orderkey")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_named_results(spark, tmp_path):
    df = scan(spark, f"{SF}/orders.parquet")
    paths = sinks.export_exploratory(df, ["o_totalprice"], ["o_orderstatus"], str(tmp_path), "parquet")
    assert set(paths) == {"numeric_summary", "frequencies_o_orderstatus"}
    assert spark.read.parquet(paths["numeric_summary"]).collect() == describe(df, ["o_totalprice"]).collect()
    assert spark.read.parquet(paths["frequencies_o_orderstatus"]).count() == frequencies(df, "o_orderstatus").count()


def test_log_order_and_filter(spark, tmp_path):
    path = str(tmp_path / "log")
    for i, op in enumerate(["impute", "reset", "scale"]):
        audit.append_step(spark, path, "clean", op, {"i": i})
    log = spark.read.parquet(path)
    assert [r["op"] for r in audit.read_log(log).collect()] == ["impute", "reset", "scale"]
    assert [r["op"] for r in audit.read_log(log, newest_first=True, without="reset").collect()] == ["scale", "impute"]


def test_schema_helpers(spark):
    df = scan(spark, f"{SF}/orders.parquet")
    assert columns_of(df, ("categorical",)) == ["o_orderstatus", "o_orderpriority"] and columns_of(df, ("date",)) == ["o_orderdate"]
    assert present_groups(df, {"a": ["o_custkey", "no"], "b": ["no"]}) == {"a": ["o_custkey"], "b": []}
    assert overview(df).where("n_rows = n_non_null").count() == 6


def test_rowwise_steps_give_the_same_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    steps = [("flag", "event_type", "!=", "click", "other"), ("winsorize", frozen_fences(events, ["value"])),
             ("log", ["value"]), ("row_sum", ["value", "user_id"], "total"), ("date_parts", "ts"), ("drop", ["props"])]
    want = apply_rowwise(events, steps)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(open(f"{SF}/events.parquet", "rb").read())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = apply_rowwise(stream, steps).writeStream.format("memory").queryName("rowwise_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("rowwise_out")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert got.agg(F.min("other"), F.max("other")).first() == (0, 1)
