"""The query catalogue: each entry is a Spark query and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.frame import Frame
from tessel.functions.hashing import bucket, fast_row_hash, row_hash, unsigned
from tessel.functions.registry import register
from tessel.operators import relational
from tessel.operators.aggregate import distinct_first, group_aggregate, group_ids, n_groups
from tessel.operators.gather import gather, scatter_add
from tessel.operators.join import equi_join, left_join_residual
from tessel.operators.partition import hash_repartition, histogram, with_bucket, write_offsets
from tessel.operators.positions import with_position
from tessel.plans.expr import assign, call, col, lit, slot, where_expression, with_expression
from tessel.sources.tables import read_table, shared_base, write_table
from tessel.streaming.windows import tumbling_aggregate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str]] = {}

#: Key columns of lineitem, and the remaining ones as tie-breakers: together a unique order.
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
UNIQUE = [*KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
K, U = ", ".join(KEY), ", ".join(UNIQUE)


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with columns that have NULLs: n (a number), f (a string)."""
    t = read_table(spark, d, "lineitem")
    return t.withColumns({"n": F.nullif(F.col("l_linenumber"), F.lit(3)), "f": F.nullif(F.col("l_returnflag"), F.lit("A"))})


_LINES = "(select *, nullif(l_linenumber, 3) as n, nullif(l_returnflag, 'A') as f from lineitem) t"


def _computed(name: str, expr, sql: str, strategy: str = "aggregate") -> None:
    """KEY and v = an expression over all of lineitem."""

    @_query(name, f"select {K}, {sql} as v from {_LINES}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_expression(_lines(spark, d), "v", expr, strategy=strategy).select(*KEY, "v")


# An order has a few lines, so aggregates by l_orderkey are windows; other keys may be hot.
_computed("add", call("+", "l_partkey", "l_suppkey"), "l_partkey + l_suppkey")
_computed("add_null", call("+", "l_partkey", "n"), "l_partkey + n")
_computed("eq_num", call("==", "n", "l_linenumber"), "n = l_linenumber")
_computed("lt_num", call("<", "n", lit(4)), "n < 4")
_computed("lteq_num", call("<=", "n", "l_suppkey"), "n <= l_suppkey")
_computed("gt_num", call(">", "n", lit(4)), "n > 4")
_computed("gteq_num", call(">=", "n", "l_suppkey"), "n >= l_suppkey")
_computed("arithmetic", call("%", call("-", call("*", "l_partkey", "n"), "l_suppkey"), lit(97)), "(l_partkey * n - l_suppkey) % 97")
_computed("divide", call("/", call("DOUBLE", "l_partkey"), call("DOUBLE", "n")), "cast(l_partkey as double) / cast(n as double)")
_computed("cast_text", call("INT", call("SUBSTRING", call("STRING", "l_orderkey"), lit(1), lit(2))), "cast(substring(cast(l_orderkey as varchar), 1, 2) as integer)")
_computed("text_functions", call("CONCAT", call("LOWER", "f"), lit("-"), call("UPPER", call("REPLACE", "l_linestatus", lit("O"), lit("open"))), call("STRING", call("LENGTH", "f"))), "lower(f) || '-' || upper(replace(l_linestatus, 'O', 'open')) || length(f)")
_computed("date_parts", call("+", call("*", call("YEAR", "l_shipdate"), lit(100)), call("+", call("MONTH", "l_shipdate"), call("DAY", "l_shipdate"))), "cast(year(l_shipdate) * 100 + month(l_shipdate) + day(l_shipdate) as integer)")
_computed("array_access", call("ELEMENT_AT", call("ARRAY", "l_partkey", "l_suppkey"), lit(2)), "[l_partkey, l_suppkey][2]")
_computed("coalesce_least", call("GREATEST", call("COALESCE", "n", lit(9)), call("LEAST", "l_linenumber", lit(5))), "greatest(coalesce(n, 9), least(l_linenumber, 5))")
_computed("predicates", call("CASE", call("IN", "n", lit(1), lit(2)), lit("low"), call("BETWEEN", "n", lit(4), lit(5)), lit("mid"), call("LIKE", "f", lit("R%")), lit("r"), lit("else")), "case when n in (1, 2) then 'low' when n between 4 and 5 then 'mid' when f like 'R%' then 'r' else 'else' end")
for _name, _op, _sql in (("eq_str", "==", "="), ("lt_str", "<", "<"), ("lteq_str", "<=", "<="), ("gt_str", ">", ">"), ("gteq_str", ">=", ">=")):
    _computed(_name, call(_op, "f", "l_linestatus"), f"f {_sql} l_linestatus")
_computed("eq_str_no_null", call("==", "l_returnflag", "l_linestatus"), "l_returnflag = l_linestatus")
_computed("expr_const", call("<", call("+", "l_partkey", call("+", "l_suppkey", "l_orderkey")), lit(5000)), "(l_partkey + (l_suppkey + l_orderkey)) < 5000")
_computed(
    "expr_placeholder",
    call("<", slot("sum"), slot("limit")).expand("sum", call("+", "l_partkey", slot("rest"))).expand("rest", call("+", "l_suppkey", "l_orderkey")).expand_const("limit", 9000),
    "(l_partkey + (l_suppkey + l_orderkey)) < 9000",
)
_computed("and_or_not", call("AND", call("NOT", call("IS NULL", "n")), call("OR", call("<", "n", lit(3)), call("==", "f", lit("R")))), "not (n is null) and (n < 3 or f = 'R')")
_computed("win_sum", call("SUM", "n").over("l_orderkey"), "cast(coalesce(sum(n) over (partition by l_orderkey), 0) as bigint)", "window")
_computed("win_sum_all_null", call("SUM", "n").over("l_linenumber"), "cast(coalesce(sum(n) over (partition by l_linenumber), 0) as bigint)")
_computed("win_sum_const", call("SUM", lit(1)).over("l_suppkey"), "cast(sum(1) over (partition by l_suppkey) as bigint)")
_computed("win_count", call("COUNT", "n").over("l_suppkey"), "count(n) over (partition by l_suppkey)")
_computed("win_count_str", call("COUNT", "f").over("l_orderkey", "l_linestatus"), "count(f) over (partition by l_orderkey, l_linestatus)", "window")
_computed("win_max", call("MAX", "n").over("l_suppkey"), "max(n) over (partition by l_suppkey)")
_computed("win_max_str", call("MAX", "f").over("l_orderkey"), "max(f) over (partition by l_orderkey)", "window")
_computed("win_min", call("MIN", "n").over("l_suppkey"), "min(n) over (partition by l_suppkey)")
_computed("win_count_distinct", call("COUNT DISTINCT", "f").over("l_suppkey"), "(select count(distinct u.f) from (select *, nullif(l_returnflag, 'A') as f from lineitem) u where u.l_suppkey = t.l_suppkey)")
_computed("win_literal_key", call("SUM", "n").over(lit(1)), "cast(sum(n) over () as bigint)")
_computed("win_null_key", call("COUNT", "l_partkey").over("n", "f"), "count(l_partkey) over (partition by n, f)")
_computed("win_expr_key", call("SUM", "l_linenumber").over(call("<", "l_partkey", lit(500))), "cast(sum(l_linenumber) over (partition by l_partkey < 500) as bigint)")
_computed("win_expr_value", call("SUM", call("+", "l_partkey", "l_suppkey")).over("l_orderkey"), "cast(sum(l_partkey + l_suppkey) over (partition by l_orderkey) as bigint)", "window")


@_query("qualify", f"select {K}, v from (select *, cast(coalesce(sum(n) over (partition by l_orderkey), 0) as bigint) as v from {_LINES}) q where v < 10")
def qualify(spark: SparkSession, d: str) -> DataFrame:
    out = with_expression(_lines(spark, d), "v", call("SUM", "n").over("l_orderkey"), strategy="window")
    return where_expression(out, call("<", "v", lit(10))).select(*KEY, "v")


@_query("qualify_inline", f"select {K} from {_LINES} qualify count(f) over (partition by l_orderkey) > 3")
def qualify_inline(spark: SparkSession, d: str) -> DataFrame:
    return where_expression(_lines(spark, d), call(">", call("COUNT", "f").over("l_orderkey"), lit(3)), strategy="window").select(*KEY)


@_query("win_nested", f"select {K}, cast(sum(s) over (partition by l_suppkey) as bigint) as v from (select *, coalesce(sum(n) over (partition by l_orderkey), 0) as s from {_LINES}) q")
def win_nested(spark: SparkSession, d: str) -> DataFrame:
    inner = call("SUM", "n").over("l_orderkey")
    return with_expression(_lines(spark, d), "v", call("SUM", inner).over("l_suppkey")).select(*KEY, "v")


@_query("win_scope_partition", f"select {K}, cast(coalesce(sum(n) over (partition by l_linestatus, l_suppkey), 0) as bigint) as v from {_LINES}")
def win_scope_partition(spark: SparkSession, d: str) -> DataFrame:
    return with_expression(_lines(spark, d), "v", call("SUM", "n").over("l_suppkey"), scope=("l_linestatus",)).select(*KEY, "v")


@_query("filter_null", f"select {K}, n from {_LINES} where n < 5")
def filter_null(spark: SparkSession, d: str) -> DataFrame:
    return where_expression(_lines(spark, d), call("<", "n", lit(5))).select(*KEY, "n")


@_query("filter_chain", f"select {K} from {_LINES} where n < 5 and l_partkey > l_suppkey and f = 'N'")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    out = where_expression(_lines(spark, d), call("<", "n", lit(5)))
    return where_expression(where_expression(out, call(">", "l_partkey", "l_suppkey")), call("==", "f", lit("N"))).select(*KEY)


@_query("filter_predicates", f"select {K} from {_LINES} where n in (1, 2) or (l_partkey between 10 and 50 and l_returnflag like 'A%') or case when f is null then l_suppkey < 5 else false end")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("n").isin(1, 2) | (F.col("l_partkey").between(10, 50) & F.col("l_returnflag").like("A%"))
    return _lines(spark, d).where(keep | F.when(F.col("f").isNull(), F.col("l_suppkey") < 5).otherwise(False)).select(*KEY)


@_query("add_assign", f"select {K}, l_suppkey + n as l_suppkey_new from {_LINES}")
def add_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("l_suppkey_new", F.col("l_suppkey"))
    return assign(rows, "l_suppkey_new", "n").select(*KEY, "l_suppkey_new")


@_query("project", "select l_partkey as part, l_orderkey, l_quantity from lineitem")
def project(spark: SparkSession, d: str) -> DataFrame:
    return relational.project(read_table(spark, d, "lineitem"), keep=["l_partkey", "l_orderkey", "l_quantity", "l_tax"], drop=["l_tax"], rename={"l_partkey": "part"})


@_query("as_string", f"select {K}, coalesce(cast(n as varchar), '(null)') as n_text, coalesce(f, '(null)') as f_text from {_LINES}")
def as_string(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    text = relational.as_text(rows.select(*KEY, "n", "f"))
    return text.select(*(F.col(c).cast(dict(rows.dtypes)[c]) for c in KEY), F.col("n").alias("n_text"), F.col("f").alias("f_text"))


@_query("row_count", "select count(*) as n_rows from lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"))


def _sized(spark: SparkSession, d: str, layout: list[int]) -> Frame:
    """The 25 nations in order of their keys, cut into logical partitions of the given sizes."""
    return Frame.from_dataframe(read_table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], layout)


_LAYOUT = [4, 0, 10, 11]
_PLACED = "(select n_nationkey, n_name, case when n_nationkey < 4 then 0 when n_nationkey < 14 then 2 else 3 end as _part, cast(n_nationkey - case when n_nationkey < 4 then 0 when n_nationkey < 14 then 4 else 14 end as bigint) as _pos from nation) t"


@_query("frame_layout", f"select n_nationkey, n_name, _part, _pos from {_PLACED}")
def frame_layout(spark: SparkSession, d: str) -> DataFrame:
    return _sized(spark, d, _LAYOUT).df


@_query("frame_push", f"select n_nationkey, n_nationkey * 3 as a, case when n_nationkey % 2 = 0 then 'v' || n_nationkey end as b from {_PLACED}")
def frame_push(spark: SparkSession, d: str) -> DataFrame:
    """Local vectors, one without and one with a validity vector."""
    f = _sized(spark, d, _LAYOUT).push("a", [i * 3 for i in range(25)], "int")
    return f.push("b", [f"v{i}" for i in range(25)], "string", [i % 2 == 0 for i in range(25)]).df.select("n_nationkey", "a", "b")


@_query("frame_writable", f"select n_nationkey, n_nationkey + case when n_nationkey <> 7 then n_nationkey end as a from {_PLACED}")
def frame_writable(spark: SparkSession, d: str) -> DataFrame:
    f = _sized(spark, d, _LAYOUT).push("a", list(range(25)), "int", [i != 7 for i in range(25)])
    return f.assign("a", "n_nationkey").df.select("n_nationkey", "a")


@_query("frame_push_index", f"select a.n_nationkey, b.n_name as name_of_mirror from {_PLACED.replace(') t', ') a')} join {_PLACED.replace(') t', ') b')} on a._part = b._part and b._pos = case a._part when 0 then 3 when 2 then 9 else 10 end - a._pos")
def frame_push_index(spark: SparkSession, d: str) -> DataFrame:
    out = _sized(spark, d, _LAYOUT).push_index([list(range(n))[::-1] for n in _LAYOUT], ["n_name"])
    return out.df.select("n_nationkey", F.col("n_name").alias("name_of_mirror"))


@_query("frame_rows", "select 10 * i as v, 'r' || i as s, case when i < 3 then 0 else 1 end as _part, cast(case when i < 3 then i else i - 3 end as bigint) as _pos from range(5) t(i)")
def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    return Frame.from_rows(spark, [(10 * i, f"r{i}") for i in range(5)], "v bigint, s string", [3, 2]).df


@_query("frame_materialize", "select n_nationkey as at, n_name as name, cast(n_nationkey as varchar) || ' | ' || n_name as line from nation")
def frame_materialize(spark: SparkSession, d: str) -> DataFrame:
    """What comes to the driver, in order, as a table again: values, and the lines that ``show`` prints."""
    f = _sized(spark, d, _LAYOUT)
    names, lines = f.materialize("n_name", "string"), [" | ".join(r) for r in f.materialize_text()]
    return spark.createDataFrame(list(zip(range(len(names)), names, lines, strict=True)), "at int, name string, line string")


@_query("frame_constant", f"select n_nationkey, 7 as k, true as k_is_constant, 7 as extracted, false as name_is_constant, 0 as truncated from {_PLACED}")
def frame_constant(spark: SparkSession, d: str) -> DataFrame:
    f = _sized(spark, d, _LAYOUT).constant("k", 7)
    facts = {"k_is_constant": f.is_constant("k"), "extracted": f.to_constant("k"), "name_is_constant": f.is_constant("n_name"), "truncated": f.truncate().n_rows()}
    return f.df.select("n_nationkey", "k", *(F.lit(v).alias(c) for c, v in facts.items()))


@_query("register_operator", f"select {K}, l_partkey * 2 + n as v from {_LINES}")
def register_operator(spark: SparkSession, d: str) -> DataFrame:
    """An operator of the caller's own, built from Columns."""
    register("TWICE PLUS", 2, lambda a, b: a * 2 + b, replace=True)
    return with_expression(_lines(spark, d), "v", call("TWICE PLUS", "l_partkey", "n")).select(*KEY, "v")


@_query("register_pandas_udf", "select o_orderkey, o_custkey % 7 as v from orders")
def register_pandas_udf(spark: SparkSession, d: str) -> DataFrame:
    """An operator that is a vectorized Python function."""
    register("MODULO 7", 1, F.pandas_udf(lambda x: x % 7, "bigint"), replace=True)
    return with_expression(read_table(spark, d, "orders"), "v", call("MODULO 7", "o_custkey")).select("o_orderkey", "v")


def _through(name: str, fmt: str, **options) -> None:
    """A table written in another format under a folder that the driver and the executors share, and read again."""

    @_query(f"source_{name}", "select n_nationkey, n_name, n_regionkey from nation")
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = f"{shared_base(spark)}/tables-{uuid.uuid4().hex}"
        nation = read_table(spark, d, "nation")
        write_table(nation, base, "nation", fmt, **options)
        return read_table(spark, base, "nation", fmt, schema=nation.schema, **options)


_through("csv", "csv", header="true")
_through("json", "json")
_through("orc", "orc")


@_query("position", f"select {U}, row_number() over (order by {U}) - 1 as pos from lineitem")
def position(spark: SparkSession, d: str) -> DataFrame:
    return with_position(read_table(spark, d, "lineitem").select(*UNIQUE), UNIQUE, "pos")


@_query("position_text", "select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority, o_orderkey) - 1 as pos from orders")
def position_text(spark: SparkSession, d: str) -> DataFrame:
    """The order leads with text."""
    return with_position(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"], "pos")


@_query("split_at", "select o_orderkey from (select *, row_number() over (order by o_orderkey) - 1 as pos from orders) t where pos >= 100")
def split_at(spark: SparkSession, d: str) -> DataFrame:
    return with_position(read_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos").where("pos >= 100").drop("pos")


@_query(
    "group_ids",
    f"select {K}, dense_rank() over (order by first) - 1 as group_id from (select *, min(rn) over (partition by l_returnflag, n) as first from (select *, row_number() over (order by {U}) as rn from {_LINES}) a) b",
)
def dense_group_ids(spark: SparkSession, d: str) -> DataFrame:
    return group_ids(_lines(spark, d), ["l_returnflag", "n"], UNIQUE).select(*KEY, "group_id")


@_query("n_groups", f"select count(*) as n_groups from (select 1 from {_LINES} group by l_returnflag, n) g")
def count_groups(spark: SparkSession, d: str) -> DataFrame:
    return n_groups(_lines(spark, d), ["l_returnflag", "n"])


@_query("n_groups_struct", f"select count(distinct row(l_returnflag, n)) as n_groups from {_LINES}")
def count_groups_struct(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).agg(F.countDistinct(F.struct("l_returnflag", "n")).alias("n_groups"))


@_query("distinct_rows", f"select distinct l_suppkey, n from {_LINES}")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return distinct_first(_lines(spark, d).select("l_suppkey", "n"), ["l_suppkey", "n"])


@_query("group_by", f"select l_suppkey, n, cast(coalesce(sum(l_linenumber), 0) as bigint) as total, count(f) as n_f, max(f) as max_f from {_LINES} group by l_suppkey, n")
def group_by(spark: SparkSession, d: str) -> DataFrame:
    return group_aggregate(_lines(spark, d), ["l_suppkey", "n"], total=("SUM", "l_linenumber"), n_f=("COUNT", "f"), max_f=("MAX", "f"))


@_query("global_aggregate", f"select cast(coalesce(sum(n), 0) as bigint) as total, count(f) as n_f, max(n) as max_n from {_LINES}")
def global_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return group_aggregate(_lines(spark, d), [], total=("SUM", "n"), n_f=("COUNT", "f"), max_n=("MAX", "n"))


def _hash_sql(x: str) -> str:
    return f"(case when {x} is null then 18446744073709551615::hugeint else ('0x' || substr(md5(cast({x} as varchar)), 1, 15))::hugeint end)"


@_query("rollup", f"select l_returnflag, l_linenumber, cast(coalesce(sum(n), 0) as bigint) as total, min(n) as low, count(*) as n_rows, count(distinct l_suppkey) as suppliers from {_LINES} group by rollup (l_returnflag, l_linenumber)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return group_aggregate(_lines(spark, d), ["l_returnflag", "l_linenumber"], "rollup", total=("SUM", "n"), low=("MIN", "n"), n_rows=("COUNT", "*"), suppliers=("COUNT DISTINCT", "l_suppkey"))


@_query("cube", f"select f, n, max(l_partkey) as high, avg(l_linenumber) as mean from {_LINES} group by cube (f, n)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return group_aggregate(_lines(spark, d), ["f", "n"], "cube", high=("MAX", "l_partkey"), mean=("AVG", "l_linenumber"))


@_query("repartition_text", "select o_orderkey, o_orderpriority, true as alone from orders")
def repartition_text(spark: SparkSession, d: str) -> DataFrame:
    """Rows with text keys move whole, and a priority's rows lie in one partition."""
    out = hash_repartition(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 8).withColumn("p", F.spark_partition_id())
    places = out.groupBy("o_orderpriority").agg((F.min("p") == F.max("p")).alias("alone"))
    return out.join(places, "o_orderpriority").select("o_orderkey", "o_orderpriority", "alone")


@_query("hash_bucket", f"select {K}, cast((({_hash_sql('n')} + {_hash_sql('l_returnflag')}) % 18446744073709551616::hugeint) % 1024 as integer) as bucket from {_LINES}")
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return with_bucket(_lines(spark, d), ["n", "l_returnflag"], 10, portable=True).select(*KEY, "bucket")


@_query("hash_row", f"select {K}, cast(({_hash_sql('f')} + {_hash_sql('l_partkey')} + {_hash_sql('n')}) % 18446744073709551616::hugeint as varchar) as h from {_LINES}")
def hash_row(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(*KEY, unsigned(row_hash("f", "l_partkey", "n")).cast("string").alias("h"))


@_query("hash_fast_properties", f"select count(*) as n_rows, count(*) as same_if_permuted, count(*) filter (n is null) as null_is_minus_one from {_LINES}")
def hash_fast_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    same = fast_row_hash("n", "l_partkey") == fast_row_hash("l_partkey", "n")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(same).alias("same_if_permuted"), F.count_if(F.col("n").isNull() & (fast_row_hash("n") == -1)).alias("null_is_minus_one"))


@_query("histogram", f"select cast({_hash_sql('l_orderkey')} % 16 as integer) as bucket, count(*) as n from lineitem group by 1")
def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(read_table(spark, d, "lineitem"), bucket(row_hash("l_orderkey"), 4))


@_query(
    "write_offsets",
    f"select bucket, worker, n, cast(coalesce(sum(n) over (partition by bucket order by worker rows between unbounded preceding and 1 preceding), 0) as bigint) as write_offset from (select cast({_hash_sql('l_orderkey')} % 16 as integer) as bucket, l_linenumber as worker, count(*) as n from lineitem group by 1, 2) t",
)
def bucket_write_offsets(spark: SparkSession, d: str) -> DataFrame:
    return write_offsets(read_table(spark, d, "lineitem"), bucket(row_hash("l_orderkey"), 4), F.col("l_linenumber"))


@_query("repartition", f"select {K}, 1 as physical_partitions_of_key from lineitem")
def repartition(spark: SparkSession, d: str) -> DataFrame:
    """Rows keep their multiset, and every key meets exactly one physical partition."""
    from pyspark.sql import Window

    out = hash_repartition(read_table(spark, d, "lineitem").select(*KEY), ["l_orderkey"], 8, KEY).withColumn("p", F.spark_partition_id())
    w = Window.partitionBy("bucket")
    n = F.when(F.min("p").over(w) == F.max("p").over(w), 1).otherwise(2)
    return out.withColumn("physical_partitions_of_key", n).select(*KEY, "physical_partitions_of_key")


@_query("gather", f"select {K}, o_custkey, o_orderstatus from lineitem left join orders on o_orderkey = l_orderkey")
def gather_orders(spark: SparkSession, d: str) -> DataFrame:
    return gather(read_table(spark, d, "lineitem").select(*KEY), read_table(spark, d, "orders"), [("l_orderkey", "o_orderkey")], ["o_custkey", "o_orderstatus"])


@_query(
    "scatter_add",
    f"select o_orderkey, case when bool_or(l_orderkey is not null and n is null) then null else o_custkey + coalesce(cast(sum(n) as bigint), 0) end as v from orders left join {_LINES} on o_orderkey = l_orderkey group by o_orderkey, o_custkey",
)
def scatter_add_orders(spark: SparkSession, d: str) -> DataFrame:
    return scatter_add(read_table(spark, d, "orders"), "o_orderkey", "o_custkey", _lines(spark, d), "l_orderkey", "n", "v").select("o_orderkey", "v")


@_query("left_join_residual", "select o_orderkey, o_custkey, l_partkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey and (o_custkey >= l_partkey or l_partkey is null) where o_custkey > 0")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    residual: Column = (F.col("o_custkey") >= F.col("l_partkey")) | F.col("l_partkey").isNull()
    out = left_join_residual(read_table(spark, d, "orders"), read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), residual, F.col("o_custkey") > 0)
    return out.select("o_orderkey", "o_custkey", "l_partkey", "l_linenumber")


for _how, _sql in (("inner", "join"), ("right", "right join"), ("full", "full join"), ("left_semi", "semi join"), ("left_anti", "anti join")):

    @_query(f"join_{_how}", f"select k{'' if 'semi' in _how or 'anti' in _how else ', o, c'} from (select o_custkey + 1 as k, o_orderkey as o from orders) a {_sql} (select c_custkey as k, c_nationkey as c from customer) b using (k)")
    def _join(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        a = read_table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("k"), F.col("o_orderkey").alias("o"))
        out = equi_join(a, read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("c")), ["k"], how)
        return out.select("k") if how in ("left_semi", "left_anti") else out


@_query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, F.col("o_totalprice").desc(), F.col("o_orderkey"))


for _how, _sql in (("union_all", "union all"), ("union", "union"), ("intersect", "intersect"), ("intersect_all", "intersect all"), ("except", "except"), ("except_all", "except all")):

    @_query(f"set_{_how}", f"select k from (select l_suppkey as k from lineitem) a {_sql} select k from (select s_suppkey + 3 as k from supplier) b")
    def _set(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        a = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
        return relational.set_operation(a, read_table(spark, d, "supplier").select((F.col("s_suppkey") + 3).alias("k")), how)


@_query("tumbling", "select time_bucket(interval 1 hour, ts) as window_start, event_type, cast(coalesce(sum(event_id), 0) as bigint) as total, count(event_id) as n from events group by 1, 2")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_aggregate(read_table(spark, d, "events"), "ts", "1 hour", ["event_type"], "event_id")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
