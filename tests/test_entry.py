import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from tessel.sources import read_table, write_table
    from tessel.streaming import tumbling_aggregate

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) as ts, id % 2 as k, id as v from range(180)")
    write_table(rows, str(tmp_path), "e")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e.parquet")
    query = tumbling_aggregate(stream, "ts", "1 hour", ["k"], "v", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    static = tumbling_aggregate(read_table(spark, str(tmp_path), "e"), "ts", "1 hour", ["k"], "v")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, static.collect()))


def test_expressions_on_a_stream(spark, tmp_path):
    """Filters, computed columns and writes work on a stream as on a table."""
    from tessel import call, lit
    from tessel.plans.expr import assign, where_expression, with_expression

    spark.range(100).selectExpr("id", "nullif(id % 5, 3) as n", "id as m").write.parquet(f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/s")

    def steps(df):
        return assign(with_expression(where_expression(df, call("<", "n", lit(4))), "v", call("*", "id", call("+", "n", lit(1)))), "m", "n")

    query = steps(stream).writeStream.format("memory").queryName("x").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("x").collect())) == sorted(map(tuple, steps(table).collect()))


def test_late_rows_in_append_mode(spark, tmp_path):
    """A window is written once the watermark has passed it; rows that come later than that are dropped."""
    from tessel.streaming import tumbling_aggregate

    def put(i, *minutes):
        spark.createDataFrame([(m, m) for m in minutes], "m int, v int").selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts", "'k' as k", "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
        return f"{tmp_path}/{i}"

    first = put(0, 5, 20)
    stream = spark.readStream.schema(spark.read.parquet(first).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    query = tumbling_aggregate(stream, "ts", "1 hour", ["k"], "v", "10 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}-c").start()
    query.processAllAvailable()
    for i, minutes in enumerate([(300,), (30, 301), (900,)], 1):  # 30 is four hours late
        put(i, *minutes)
        query.processAllAvailable()
    query.stop()
    assert sorted((r.window_start.hour, r.total, r.n) for r in spark.table("late").collect()) == [(0, 25, 2), (5, 601, 2)]


def test_temporary_base_needs_a_local_master():
    from types import SimpleNamespace as Some

    from tessel.sources.tables import shared_base

    def session(master):
        # Without spark.checkpoint.dir, and with no way to set it.
        return Some(conf=Some(get=lambda k, d: None), sparkContext=Some(getConf=lambda: Some(get=lambda k: None), master=master, applicationId=f"app-{master}"))

    assert shared_base(session("local[2]")) == shared_base(session("local[2]"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_base(session("yarn"))
