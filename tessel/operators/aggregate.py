"""Collapsed aggregates, group counts and dense group ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.registry import lookup
from tessel.operators.join import join_groups
from tessel.operators.positions import with_position


GROUPINGS = ("group", "rollup", "cube")


def group_aggregate(df: DataFrame, keys: list[str | Column], grouping: str = "group", **aggregates: tuple[str, str]) -> DataFrame:
    """``GROUP BY keys`` (or ROLLUP, or CUBE) with ``name=(operator, column)``; no keys: one global row.

    The column of COUNT may be ``*``. Spark aggregates partially before the exchange, so a hot key costs one row per task.
    """
    if grouping not in GROUPINGS:
        raise ValueError(f"unknown grouping {grouping!r}; one of {', '.join(GROUPINGS)}")
    out = []
    for name, (op, column) in aggregates.items():
        if lookup(op, 1).kind != "aggregate":
            raise ValueError(f"{op!r} is no aggregate")
        value = lookup(op, 1).build(F.lit(1) if column == "*" else F.col(column))
        out.append((F.coalesce(value, F.lit(0)) if op == "SUM" else value).alias(name))
    return {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[grouping](*keys).agg(*out)


def n_groups(df: DataFrame, keys: list[str], name: str = "n_groups") -> DataFrame:
    """How many distinct key tuples there are, NULL being a value."""
    return df.groupBy(*keys).agg(F.lit(1).alias("__one")).agg(F.count("*").alias(name))


def group_ids(df: DataFrame, keys: list[str], order_by: list[str], name: str = "group_id") -> DataFrame:
    """Ids 0..n-1 of the key tuples in order of first appearance under ``order_by`` (a unique order, NULL first).

    Only the first row of each group decides. The smallest leading value of each group is found first, in a hash
    aggregate that is combined before its exchange; order tuples are compared among the rows that have it. The groups are
    numbered by their first tuples and return by a NULL-safe join, large ones by a broadcast.
    """
    keys = list(dict.fromkeys(keys))
    named = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    theirs = {k: f"__k{i}" for i, k in enumerate(keys)}
    same = [F.col(f"`{k}`").eqNullSafe(F.col(t)) for k, t in theirs.items()]
    lead, ours = F.col(f"`{order_by[0]}`"), list(theirs.values())
    leads = df.groupBy(*named).agg(F.when(F.max(lead.isNull()), F.lit(None)).otherwise(F.min(lead)).alias("__lead"), F.count("*").alias("__n"))
    heads = df.join(leads, [*same, lead.eqNullSafe(F.col("__lead"))])
    groups = heads.groupBy(*ours).agg(F.min(F.struct(*(f"`{c}`" for c in order_by))).alias("__first"), F.max("__n").alias("__n"))
    ids = with_position(groups, ["__first"], name).drop("__first")
    return join_groups(df, ids, theirs, "__n", order_by)


def distinct_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key tuple."""
    return df.dropDuplicates(keys)
