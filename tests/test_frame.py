"""Golden fixtures on nine-row tables with explicit layouts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel import Frame, call, col, lit, slot
from tessel.functions import registry
from tessel.functions.hashing import bucket, fast_row_hash, row_bucket, row_hash
from tessel.operators import join
from tessel.operators.aggregate import group_ids
from tessel.operators.partition import hash_repartition, with_bucket
from tessel.operators.positions import with_position
from tessel.plans.expr import with_expression

N = None
LAYOUT = [2, 2, 2, 2, 1]
TWICE = [[0, 0]] * 4 + [[0]]


def frame(spark, schema, *columns, layout=LAYOUT):
    return Frame.from_rows(spark, list(zip(*columns, strict=True)), schema, layout)


def names(*xs):
    return [x and f"{x}A" for x in xs]


def test_strings_round_trip(spark):
    f = frame(spark, "name string", ["Jane", "Merry", "", "Christopher", "Peter"], layout=[2, 2, 1])
    assert f.materialize("name") == ["Jane", "Merry", "", "Christopher", "Peter"]
    assert [r[0] for r in f.df.orderBy("_part", "_pos").select(F.octet_length("name")).collect()] == [4, 5, 0, 11, 5]
    with pytest.raises(ValueError, match="is string"):
        f.materialize("name", "bigint")


def test_push(spark):
    f = frame(spark, "c bigint", range(1, 10)).push("d", list(range(9)), "bigint", [i != 1 for i in range(9)])
    assert f.materialize("d") == [0, N, 2, 3, 4, 5, 6, 7, 8]
    assert f.constant("k", 7).materialize("k") == [7] * 9
    assert f.n_rows() == 9 and f.columns == ["c", "d"]
    for bad in ([1], list(range(10))):
        with pytest.raises(ValueError):
            f.push("e", bad, "bigint")
    with pytest.raises(ValueError):
        Frame.from_rows(spark, [(1,)], "c bigint", [2])
    with pytest.raises(ValueError):
        f.push_index([[5, 0]] + TWICE[1:], ["c"])


def test_push_after_a_filter(spark):
    f = frame(spark, "c bigint", range(1, 10)).filter(call(">", "c", lit(3))).push("d", list("abcdef"), "string")
    assert list(zip(f.materialize("c"), f.materialize("d"), strict=True)) == list(zip(range(4, 10), "abcdef", strict=True))


def test_constants(spark):
    f = frame(spark, "c bigint", range(1, 10)).constant("k", None).constant("s", "x")
    assert f.is_constant("k") and f.is_constant("s") and not f.is_constant("c")
    assert f.to_constant("s") == "x" and f.to_constant("k") is None
    with pytest.raises(ValueError, match="several values"):
        f.to_constant("c")
    none = f.truncate()
    assert none.n_rows() == 0 and none.columns == ["c", "k", "s"] and none.is_constant("c")
    with pytest.raises(ValueError, match="no values"):
        none.to_constant("c")


def test_add_assign(spark):
    f = frame(spark, "c1 bigint, c2 bigint", [1, N, *range(3, 10)], [*range(1, 9), N])
    assert f.assign("c1", "c2").materialize("c1") == [2, N, 6, 8, 10, 12, 14, 16, N]
    with pytest.raises(ValueError):
        f.assign("c1", "c1")


def test_equality_through_an_index(spark):
    f = frame(spark, "c0 bigint, c1 bigint", [1, 2, 3, 4, 5, 7, 7, 8, N], [1, N, *range(3, 10)]).push_index(TWICE, ["c0"])
    assert f.materialize("c0") == [1, 1, 3, 3, 5, 5, 7, 7, N]
    assert f.with_expression("out", call("==", "c1", "c0")).materialize("out") == [True, N, True, False, True, False, True, False, N]


def test_string_equality_and_filter(spark):
    a, b = names(1, N, *range(3, 10)), names(*range(1, 9), N)
    f = frame(spark, "a string, b string", a, b).push_index(TWICE, ["b"])
    eq = call("==", "a", "b")
    assert f.with_expression("out", eq).materialize("out") == [True, N, True, False, True, False, True, False, N]
    assert f.filter(eq).materialize("b") == names(1, 3, 5, 7)
    assert f.filter(eq).filter(call(">", "a", lit("2"))).materialize("b") == names(3, 5, 7)


def test_nested_expression_with_placeholders(spark):
    f = frame(spark, "c0 bigint, c1 bigint, c2 bigint", [1, 2, 3, 4, 5, 7, 7, 8, N], [1, N, *range(3, 10)], [1, 2, 3, 4, N, 6, 7, 8, 9]).push_index(TWICE, ["c0"])
    e = call("<", call("+", "c0", slot("s")), slot("k")).expand("s", call("+", "c1", "c2")).expand_const("k", 16)
    assert f.with_expression("out", e).materialize("out") == [True, N, True, True, N, False, False, False, N]
    with pytest.raises(ValueError, match="no placeholder"):
        e.expand("s", col("c0"))
    with pytest.raises(ValueError, match="has no value"):
        f.with_expression("out", call("+", "c0", slot("s")))
    keyed = call("SUM", "c1").over(slot("key")).expand("key", col("c2"))
    assert keyed.keys == (col("c2"),)


def test_hashes(spark):
    f = frame(spark, "a string, b string", names(1, N, *range(3, 10)), names(*range(1, 9), N)).push_index(TWICE, ["b"])
    for h, word in ((row_hash, 2**64), (fast_row_hash, 2**64)):
        rows = f.df.orderBy("_part", "_pos").select(h("b").alias("h1"), h("b", "a").alias("h2"), h("a", "b").alias("h3")).collect()
        h1 = [int(r.h1) % word for r in rows]
        assert [h1[i] == h1[i + 1] for i in (0, 2, 4, 6)] == [True] * 4 and len(set(h1)) == 5
        assert h1[8] == 2**64 - 1
        assert int(rows[1].h2) % word == (h1[1] - 1) % word
        assert all(r.h2 == r.h3 for r in rows)
        low = [row_bucket(x, 9, h is row_hash) == bucket(h(*x), 9) for x in (["a"], ["b", "a"])]
        assert all(all(r) for r in f.df.select(*low).collect())


@pytest.mark.parametrize("bits", [1, 2, 8, 12])
def test_repartition(spark, bits):
    f = frame(spark, "c1 bigint, c2 string", [1, N, *range(3, 10)], names(1, 1, 3, 3, 5, 5, 7, 7, N))
    out = hash_repartition(f.df, ["c2"], bits, ["_part", "_pos"], 4).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.c1 or 0, r.c2 or "") for r in out) == sorted((a or 0, b or "") for a, b in zip([1, N, *range(3, 10)], names(1, 1, 3, 3, 5, 5, 7, 7, N), strict=True))
    where = {}
    for r in out:
        where.setdefault(r.c2, set()).add((r.bucket, r.p))
    assert all(len(x) == 1 for x in where.values())
    assert next(iter(where[N]))[0] == 2**bits - 1
    assert [r.bucket for r in with_bucket(f.df, ["c2"], bits).where("c2 is null").collect()] == [2**bits - 1]


def test_group_ids(spark):
    c0, c1 = names(1, N, 3, 3, 5, 6, 7, 8, 8), names(1, 2, 3, 4, 5, 6, N, 8, N)
    f = frame(spark, "c0 string, c1 string", c0, c1, layout=[4, 5]).push_index([[0, 0, 2, 2], [0, 0, 2, 2, 4]], ["c1"])
    assert f.group_ids(["c1"]).materialize("group_id") == [0, 0, 1, 1, 0, 0, 1, 1, 1]
    assert f.group_ids(["c1", "c0"]).materialize("group_id") == [0, 1, 2, 2, 0, 1, 2, 3, 3]
    g = frame(spark, "x bigint, s string", [1, 2], ["a", "a"], layout=[2])
    assert g.group_ids(["x", "s"]).materialize("group_id") == [0, 1]


def test_window_sum_by_scope(spark):
    k, v = names(1, N, 3, 3, 5, 6, 5, 8, 8), [1, 1, 3, 3, 5, 5, 7, 7, N]
    f = frame(spark, "k string, v bigint", k, v, layout=[4, 5])
    assert f.with_expression("s", call("SUM", "v").over("k"), scope="partition").materialize("s") == [1, 1, 6, 6, 12, 5, 12, 7, 7]
    g = frame(spark, "k string, v bigint", ["a", "a", "b"], [1, 2, N], layout=[1, 1, 1])
    assert g.with_expression("s", call("SUM", "v").over("k")).materialize("s") == [3, 3, 0]
    assert g.with_expression("s", call("SUM", "v").over("k"), scope="partition").materialize("s") == [1, 2, 0]
    assert g.with_expression("s", call("SUM", "v").over(lit(1))).materialize("s") == [3, 3, 3]
    assert g.with_expression("s", call("COUNT", lit(1)).over("k")).materialize("s") == [2, 2, 1]
    assert g.with_expression("s", call("MAX", "v").over("k")).materialize("s") == [2, 2, N]


@pytest.mark.parametrize("op", ["SUM", "COUNT", "MAX", "MIN", "AVG"])
def test_a_hot_key_is_combined_before_its_exchange(spark, op):
    """One key (a NULL) has nine of ten rows; both strategies agree, and only a partial result of the key is moved."""
    rows = spark.range(20_000).selectExpr("if(id % 10 < 9, null, id % 77) as k", "if(id % 3 = 0, null, id) as v", "id")
    a, b = (with_expression(rows, "s", call(op, "v").over("k"), strategy=s) for s in ("aggregate", "window"))
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() == 20_000
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and f"partial_{op.lower()}" in plan
    assert "Window" in b._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown strategy"):
        with_expression(rows, "s", call(op, "v").over("k"), strategy="other")


@pytest.mark.parametrize("key", ["if(id % 10 < 9, null, id % 77)", "id % 10 < 9"])
def test_rows_of_a_hot_key_are_not_put_into_one_task(spark, monkeypatch, key):
    """Nine of ten rows have one key, and Spark neither broadcasts groups by itself nor changes the plan while it runs."""
    monkeypatch.setattr(join, "HEAVY", 1000)
    rows = spark.range(0, 20_000, 1, 8).selectExpr(f"{key} as k", "id % 5 as v", "id")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        summed, numbered = with_expression(rows, "s", call("SUM", "v").over("k")), group_ids(rows, ["k"], ["id"])
        assert summed.columns == ["k", "v", "id", "s"] and numbered.columns == ["k", "v", "id", "group_id"]
        for out in (summed, numbered):
            tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(tasks) == 20_000 and max(tasks) < 10_000
        want = with_expression(rows, "s", call("SUM", "v").over("k"), strategy="window")
        assert summed.exceptAll(want).count() == 0 == want.exceptAll(summed).count()
        firsts = {r.k: r.id for r in rows.groupBy("k").agg(F.min("id").alias("id")).collect()}
        order = sorted(firsts, key=firsts.get)
        assert {r.k: r.group_id for r in numbered.select("k", "group_id").distinct().collect()} == {k: i for i, k in enumerate(order)}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_names_that_look_like_temporaries(spark):
    f = frame(spark, "__w_0 bigint, __w_1_k0 bigint", [1, 2], [3, 3], layout=[2])
    assert f.with_expression("s", call("+", "__w_0", call("SUM", "__w_0").over("__w_1_k0"))).materialize("s") == [4, 5]


def test_group_ids_of_a_table(spark):
    """Ties and NULLs in the leading column of the order."""
    rows = spark.createDataFrame([(None, 3, "b"), (None, 1, "a"), (1, 1, "c"), (1, 0, None), (2, 9, "a"), (2, 8, None), (0, 5, "b")], "x int, y int, k string")
    got = {(r.x, r.y): r.group_id for r in group_ids(rows, ["k"], ["x", "y"]).collect()}
    assert got == {(None, 1): 0, (2, 9): 0, (None, 3): 1, (0, 5): 1, (1, 0): 2, (2, 8): 2, (1, 1): 3}
    assert group_ids(rows.limit(0), ["k"], ["x", "y"]).collect() == []


def test_empty_partitions_and_tables(spark):
    f = frame(spark, "v bigint", [1, 2], layout=[0, 2, 0])
    assert f.with_expression("s", call("<", "v", lit(2))).materialize("s") == [True, False]
    e = frame(spark, "v bigint", [], layout=[])
    assert e.with_expression("s", call("SUM", "v").over("v")).materialize("s") == []


def test_layout_from_a_dataframe(spark):
    f = Frame.from_dataframe(spark.range(10).withColumn("x", -F.col("id")), ["x"], [3, 0, 7])
    assert f.materialize("id") == list(range(9, -1, -1))
    assert [r[0] for r in f.df.groupBy("_part").count().orderBy("_part").select("count").collect()] == [3, 7]
    a, b = f.split_at(1)
    assert a.n_rows() == 2 and b.n_rows() == 8
    with pytest.raises(ValueError):
        Frame.from_dataframe(spark.range(3), ["id"], [1])


@pytest.mark.parametrize("kind", ["string", "binary", "date", "timestamp", "boolean", "decimal(12,2)", "double", "bigint", "array", "struct"])
def test_positions_by_any_leading_type(spark, kind):
    numbers = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") * 7919) % 101)
    lead = {"date": F.date_from_unix_date(numbers.cast("int")), "timestamp": F.timestamp_micros(numbers), "boolean": numbers % 2 == 0, "binary": numbers.cast("string").cast("binary"), "array": F.array(numbers % 3, numbers), "struct": F.struct(numbers.alias("a"))}.get(kind)
    lead = numbers.cast(kind) if lead is None else lead
    if kind == "string":
        lead = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 11 == 1, F.concat(F.lit("\u00e9 long "), lead)).otherwise(lead)
    rows = spark.range(300).select(lead.alias("x"), "id")
    got = [r.id for r in with_position(rows, ["x", "id"], ranges=23).orderBy("_pos").collect()]
    assert got == [r.id for r in rows.orderBy("x", "id").collect()]


@pytest.mark.parametrize("ranges", [2, 5, 64, 1000])
def test_a_row_finds_its_range_in_few_compiled_steps(spark, ranges):
    """No lambda runs over the cuts for each row, and steps grow with the logarithm of the ranges."""
    x = "case id % 6 when 0 then null when 1 then double('NaN') when 2 then -0.0D when 3 then 0.0D when 4 then -double('inf') else id % 40 end"
    rows = spark.range(400).selectExpr(f"{x} as x", "if(id % 5 = 0, null, id % 9) as y", "(id * 7919) % 400 as id")
    out = with_position(rows, ["x", "y", "id"], ranges=ranges)
    places = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "__range" in line]
    assert places and not any("lambda" in line for line in places)
    # The rows are placed twice: for the sizes of the ranges, and to be numbered.
    assert sum("CASE WHEN" in line for line in places) == 2 * (ranges - 1).bit_length()
    want = rows.withColumn("_pos", (F.row_number().over(Window.orderBy("x", "y", "id")) - 1).cast("bigint"))
    assert [r._pos for r in out.orderBy("id").collect()] == [r._pos for r in want.orderBy("id").collect()]


def test_text(spark):
    f = frame(spark, "a bigint, b string", [1, N], [N, "x"], layout=[2])
    assert f.show() == "1 | (null)\n(null) | x"


def test_registry():
    with pytest.raises(ValueError, match="unknown operator"):
        call("no such one", "a", "b")
    with pytest.raises(ValueError, match="one or more"):
        call("COALESCE")
    with pytest.raises(ValueError, match="takes 2 inputs"):
        call("+", "a")
    with pytest.raises(ValueError, match="registered already"):
        registry.register("+", 2, lambda a, b: a)
    registry.register("TIMES", 2, lambda a, b: a * b, replace=True)
    assert call("TIMES", "a", "b").op in registry.names()
