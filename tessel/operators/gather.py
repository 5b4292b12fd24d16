"""Gather through an index, and its inverse, scatter-add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(index: DataFrame, base: DataFrame, on: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """``index`` with ``columns`` of the row of ``base`` that it points to; a dangling pointer gives NULLs.

    ``on``: pairs (pointer column of index, key column of base). ``base`` has one row a key; Spark
    broadcasts it if its size is under spark.sql.autoBroadcastJoinThreshold and shuffles both otherwise.
    """
    clash = [c for c in columns if c in index.columns]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    keyed = base.select(*(F.col(b).alias(f"__g{i}") for i, (_, b) in enumerate(on)), *columns)
    cond = [F.col(a) == F.col(f"__g{i}") for i, (a, _) in enumerate(on)]
    return index.join(keyed, cond, "left").drop(*(f"__g{i}" for i in range(len(on))))


def scatter_add(target: DataFrame, key: str, value: str, addends: DataFrame, addend_key: str, addend: str, name: str) -> DataFrame:
    """``value[key] += addend`` for every addend; repeats add up and one NULL addend makes the target NULL.

    Addends are summed per key before the exchange, so a hot key costs one row per task.
    """
    sums = addends.groupBy(F.col(addend_key).alias("__k")).agg(
        F.sum(addend).alias("__s"), F.max(F.col(addend).isNull().cast("int")).alias("__null")
    )
    out = F.when(F.col("__null") == 1, F.lit(None)).otherwise(F.col(value) + F.coalesce(F.col("__s"), F.lit(0)))
    return target.join(sums, F.col(key) == F.col("__k"), "left").withColumn(name, out).drop("__k", "__s", "__null")
