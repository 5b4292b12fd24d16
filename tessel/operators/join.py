"""Outer equi-join with a residual predicate, and plain joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def left_join_residual(left: DataFrame, right: DataFrame, on: Column, residual: Column | None = None, where: Column | None = None) -> DataFrame:
    """LEFT OUTER JOIN on equal keys and ``residual``; left rows without a partner stay, with NULLs.

    ``where`` filters the joined rows; Catalyst moves what concerns only the left side below the join.
    """
    joined = left.join(right, on if residual is None else on & residual, "left")
    return joined if where is None else joined.where(where)


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Beyond the reference: the other join types. Keys are required, so no cross join can slip in."""
    if how not in HOWS:
        raise ValueError(f"unknown join {how!r}")
    if not keys:
        raise ValueError("a join needs keys")
    return left.join(right, keys, how)


#: Groups of so many rows are broadcast by ``join_groups``: one in so many rows at most.
HEAVY = 100_000
#: Groups that the types of their keys allow, up to which all of them are broadcast.
_FEW = 10_000


def join_groups(df: DataFrame, groups: DataFrame, keys: dict[str, str], n: str, spread: list[str], heavy: int | None = None) -> DataFrame:
    """``df`` left-joined NULL-safely with ``groups`` of its own rows, so that no task has to read a large group whole.

    ``keys``: columns of ``df`` -> columns of ``groups``; the latter are dropped with ``n``, the rows of each group. Groups of
    ``heavy`` rows or more are broadcast first. Rows that found theirs can't meet another one, so the exchange that joins
    the rest deals them out by the columns ``spread`` and by the partition that they come from. Keys that are all BOOLEAN
    have few groups: these are broadcast, without an exchange of rows.
    """
    theirs, values, types = list(keys.values()), [c for c in groups.columns if c not in (n, *keys.values())], {c.lower(): t for c, t in df.dtypes}
    same = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in keys.items()]
    if all(types[k.lower()] == "boolean" for k in keys) and 3 ** len(keys) <= _FEW:
        return df.join(F.broadcast(groups), same, "left").drop(*theirs, n)
    heavy = HEAVY if heavy is None else heavy
    rows, deal, none, large = f"{n}_rows", f"{n}_deal", f"{n}_none", {v: f"{n}_{v}" for v in values}
    out = df.join(F.broadcast(groups.where(F.col(n) >= heavy).withColumnsRenamed({n: rows} | large)), same, "left").drop(*theirs)
    # Where a row goes must be the same when its task is repeated. Maps and variants have no hash.
    by = [F.col(f"`{c}`") for c in spread if not any(x in types[c.lower()] for x in ("map<", "variant"))]
    apart = F.xxhash64(F.spark_partition_id(), *by).bitwiseOR(F.lit(1))
    out = out.withColumn(deal, F.when(F.col(rows).isNotNull(), apart).otherwise(F.lit(0)))
    # 0 for every group, but no literal: that would be no key of the exchange.
    rest = groups.where(F.col(n) < heavy).withColumn(none, F.least(F.col(n), F.lit(0)))
    out = out.join(rest, [F.col(deal) == F.col(none), *same], "left")
    found = {v: F.when(F.col(rows).isNotNull(), F.col(f"`{w}`")).otherwise(F.col(f"`{v}`")) for v, w in large.items()}
    return out.withColumns(found).drop(rows, deal, none, n, *theirs, *large.values())
