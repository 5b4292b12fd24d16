"""Histograms and hash repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.hashing import row_bucket


def histogram(df: DataFrame, bucket_col: Column, name: str = "bucket") -> DataFrame:
    """Rows for each bucket, combined before the exchange."""
    return df.groupBy(bucket_col.alias(name)).agg(F.count("*").alias("n"))


def write_offsets(df: DataFrame, bucket_col: Column, worker: Column) -> DataFrame:
    """Rows for each (bucket, worker) and the exclusive prefix sum over workers inside the bucket."""
    counts = df.groupBy(bucket_col.alias("bucket"), worker.alias("worker")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("write_offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def with_bucket(df: DataFrame, keys: list[str], bits: int, name: str = "bucket", portable: bool = False) -> DataFrame:
    """``df`` with each row's bucket 0..2^bits-1; equal keys share one, all-NULL single keys take the last.

    ``portable`` takes the md5 hash that other engines can repeat, at several times the cost.
    """
    return df.withColumn(name, row_bucket(keys, bits, portable))


def hash_repartition(df: DataFrame, keys: list[str], bits: int, order_by: list[str] | None = None, partitions: int | None = None, name: str = "bucket", portable: bool = False) -> DataFrame:
    """Whole rows moved so that a bucket lies in one physical partition, in ``order_by`` order inside it."""
    out = with_bucket(df, keys, bits, name, portable)
    out = out.repartition(partitions, name) if partitions else out.repartition(name)
    return out.sortWithinPartitions(name, *order_by) if order_by else out
