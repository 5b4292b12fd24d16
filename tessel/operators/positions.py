"""Row positions from a declared order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each range: sizes of ranges differ by about a fifth then.
_SAMPLED = 24


def _cuts(df: DataFrame, order_by: list[str], ranges: int) -> DataFrame:
    """One row: the ascending order tuples, ``ranges`` - 1 at most, that cut ``df`` into parts of about equal size.

    They come from the rows of smallest hash, a sample of fixed size that any repetition of the query finds again.
    """
    order = [f"`{c}`" for c in order_by]
    sample = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(_SAMPLED * ranges)
    got = sample.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("a"))
    at = F.sequence(F.lit(1), F.lit(ranges - 1))
    cuts = F.transform(at, lambda i: F.get("a", F.floor(i * F.size("a") / ranges).cast("int")))
    return got.select(F.filter(cuts, lambda c: c.isNotNull()))


def _with_range(df: DataFrame, order_by: list[str], ranges: int) -> DataFrame:
    """``df`` with ``__range``: how many of the cuts are not above the row's order tuple.

    A binary search, a column for each step: lambdas would not be compiled, and one expression would double with each step.
    """
    mine = F.struct(*(f"`{c}`" for c in order_by))
    out = df.withColumn("__cuts", _cuts(df, order_by, ranges).scalar()).withColumns({"__mine": mine, "__range": F.lit(0)})
    for k in reversed(range((ranges - 1).bit_length())):
        # Behind the last cut the comparison is NULL.
        up = F.get("__cuts", F.col("__range") + (2**k - 1)) <= F.col("__mine")
        out = out.withColumn("__range", F.col("__range") + F.when(up, 2**k).otherwise(0))
    return out.drop("__cuts", "__mine")


def with_position(df: DataFrame, order_by: list[str], name: str = "_pos", ranges: int | None = None) -> DataFrame:
    """0-based position of each row under the unique order ``order_by`` (ascending, NULL first), as BIGINT.

    Quantiles of the whole order tuple cut the rows into ranges, which a row finds in log2(``ranges``) comparisons; rows are
    numbered inside each and shifted by the sizes of the ranges before, which is a broadcast of ``ranges`` rows. Nothing is
    collected; any orderable type may lead.
    """
    if not order_by:
        raise ValueError("positions need an order")
    if ranges is None:
        ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    ranged = _with_range(df, order_by, ranges) if ranges > 1 else df.withColumn("__range", F.lit(0))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # One row for each range: bounded by ``ranges`` whatever the input.
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    numbered = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return (
        numbered.join(F.broadcast(before), "__range")
        .withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("bigint"))
        .drop("__range", "__before", "__in")
    )


def with_layout(df: DataFrame, order_by: list[str], sizes: list[int], part: str = "_part", pos: str = "_pos") -> DataFrame:
    """Logical partitions of the given sizes, in order: ``part`` and the position inside it.

    ``sizes`` must add up to the row count; this is checked, so it costs one count.
    """
    if any(s < 0 for s in sizes):
        raise ValueError("partition sizes can't be negative")
    if (n := df.count()) != sum(sizes):
        raise ValueError(f"partition sizes add up to {sum(sizes)}, the table has {n} rows")
    ends, total = [], 0
    for s in sizes:
        ends.append(total := total + s)
    rows = with_position(df, order_by, "__row")
    if not sizes:
        return rows.withColumn(part, F.lit(0)).withColumn(pos, F.col("__row")).drop("__row")
    end = F.array(*(F.lit(e).cast("bigint") for e in ends))
    starts = F.array(*(F.lit(e - s).cast("bigint") for e, s in zip(ends, sizes, strict=True)))
    k = F.size(F.filter(end, lambda e: e <= F.col("__row")))
    return rows.withColumn(part, k.cast("int")).withColumn(pos, F.col("__row") - F.element_at(starts, k + 1)).drop("__row")
