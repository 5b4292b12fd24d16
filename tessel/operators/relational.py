"""Beyond the reference: projection helpers, ordering, limits and set operations, as thin pass-throughs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Reorder and keep, then drop, then rename; unknown names are an error."""
    for names in (keep or [], drop or [], list(rename or {})):
        if missing := [c for c in names if c not in df.columns]:
            raise ValueError(f"no column {', '.join(missing)}")
    out = df.select(*keep) if keep is not None else df
    out = out.drop(*drop) if drop else out
    return out.withColumnsRenamed(rename) if rename else out


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows under ``order``: a heap of k in each task, merged once."""
    return df.orderBy(*order).limit(k)


def as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every value as text, NULL as ``(null)``."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns or df.columns))


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    how_map = {"union_all": a.unionByName, "union": lambda x: a.unionByName(x).distinct(), "intersect": a.intersect, "except": a.subtract, "intersect_all": a.intersectAll, "except_all": a.exceptAll}
    if how not in how_map:
        raise ValueError(f"unknown set operation {how!r}")
    return how_map[how](b)
