"""Thin, uniform access to Spark's own connectors.

The engine adds nothing to Spark's scans on purpose: filters and column lists written on the returned
DataFrame reach the Parquet reader by themselves.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


#: Application -> its temporary folder, on a local master without spark.checkpoint.dir.
_TEMPORARY: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local master may do with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        # The setting itself can't be changed in a session that runs.
        app = spark.sparkContext.applicationId
        if app not in _TEMPORARY:
            _TEMPORARY[app] = f"file://{tempfile.mkdtemp(prefix='tessel-')}"
        base = _TEMPORARY[app]
    return base.rstrip("/")


def read_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """Table ``name`` under the directory ``base`` (any URI that Spark's readers can open)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(f"{base}/{name}.{fmt}")


def write_table(df: DataFrame, base: str, name: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{base}/{name}.{fmt}")
