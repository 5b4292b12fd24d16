"""A table with an explicit logical layout: a DataFrame plus ``_part`` and ``_pos`` columns.

Only what needs row positions lives here; everything else works on plain DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.operators.positions import with_layout
from tessel.operators.relational import as_text
from tessel.plans.expr import Node, assign, where_expression, with_expression

PART, POS = "_part", "_pos"


class Frame:
    """Immutable; every method returns a new Frame or plain values."""

    def __init__(self, df: DataFrame):
        if missing := [c for c in (PART, POS) if c not in df.columns]:
            raise ValueError(f"a Frame needs the columns {', '.join(missing)}")
        self.df = df

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[tuple], schema: str, layout: Sequence[int]) -> Frame:
        """Local rows (tests, small inputs) cut into logical partitions of the sizes in ``layout``."""
        if sum(layout) != len(rows):
            raise ValueError(f"layout adds up to {sum(layout)}, there are {len(rows)} rows")
        place = [(p, i) for p, n in enumerate(layout) for i in range(n)]
        fields = f"{schema}, {PART} int, {POS} bigint"
        return cls(spark.createDataFrame([(*r, *at) for r, at in zip(rows, place, strict=True)], fields))

    @classmethod
    def from_dataframe(cls, df: DataFrame, order_by: list[str], layout: list[int]) -> Frame:
        return cls(with_layout(df, order_by, layout, PART, POS))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (PART, POS)]

    def n_rows(self) -> int:
        return self.df.count()

    def push(self, name: str, values: Sequence, type_: str, valid: Sequence[bool] | None = None) -> Frame:
        """A local vector as a new column, by position; its length must match. ``valid`` False makes NULL."""
        if name in self.df.columns:
            raise ValueError(f"column {name!r} exists")
        if valid is not None and len(valid) != len(values):
            raise ValueError("values and validity differ in length")
        sizes = self._sizes()
        if sum(sizes.values()) != len(values):
            raise ValueError(f"{len(values)} values for {sum(sizes.values())} rows")
        shown = [v if valid is None or valid[i] else None for i, v in enumerate(values)]
        place = [(p, i) for p in sorted(sizes) for i in range(sizes[p])]
        rows = [(*at, v) for at, v in zip(place, shown, strict=True)]
        vector = self.df.sparkSession.createDataFrame(rows, f"{PART} int, __rank bigint, `{name}` {type_}")
        # Filters leave gaps in positions, so a vector meets ranks; it is local, so this table is no larger than the driver.
        ranked = self.df.withColumn("__rank", (F.row_number().over(Window.partitionBy(PART).orderBy(POS)) - 1).cast("bigint"))
        return Frame(ranked.join(vector, [PART, "__rank"], "left").drop("__rank"))

    def _sizes(self) -> dict[int, int]:
        """Rows of each logical partition: one number for each comes to the driver."""
        return {r[PART]: r["n"] for r in self.df.groupBy(PART).agg(F.count("*").alias("n")).collect()}

    def constant(self, name: str, value: object) -> Frame:
        return Frame(self.df.withColumn(name, F.lit(value)))

    def is_constant(self, name: str) -> bool:
        """Whether all rows have the same value (NULL being one); true for an empty table."""
        return self.df.agg(F.count_distinct(F.struct(name)) <= 1).first()[0]

    def to_constant(self, name: str) -> object:
        """The one value of a column that is constant; an error for others and for empty tables."""
        got = self.df.select(name).distinct().limit(2).collect()
        if len(got) != 1:
            raise ValueError(f"column {name!r} has {'no' if not got else 'several'} values")
        return got[0][0]

    def truncate(self) -> Frame:
        """No rows, the same columns."""
        return Frame(self.df.limit(0))

    def push_index(self, index: Sequence[Sequence[int]], columns: Sequence[str]) -> Frame:
        """Read ``columns`` through a gather vector per partition: row i shows the value at ``index[part][i]``."""
        if missing := [c for c in columns if c not in self.columns]:
            raise ValueError(f"no column {', '.join(missing)}")
        sizes = self._sizes()
        for p, part in enumerate(index):
            if part and len(part) != sizes.get(p, 0):
                raise ValueError(f"index of partition {p} has {len(part)} entries for {sizes.get(p, 0)} rows")
            if any(not 0 <= i < sizes.get(p, 0) for i in part):
                raise ValueError(f"index of partition {p} points outside it")
        if len(index) < len(sizes):
            raise ValueError("an index needs a vector for each partition")
        rows = [(p, i, j) for p, part in enumerate(index) for i, j in enumerate(part or range(sizes.get(p, 0)))]
        pointers = self.df.sparkSession.createDataFrame(rows, f"{PART} int, {POS} bigint, __at bigint")
        values = self.df.select(F.col(PART).alias("__p"), F.col(POS).alias("__i"), *(F.col(c).alias(f"__v_{c}") for c in columns))
        out = self.df.drop(*columns).join(pointers, [PART, POS]).join(values, (F.col(PART) == F.col("__p")) & (F.col("__at") == F.col("__i")))
        named = [F.col(f"__v_{c}").alias(c) if c in columns else F.col(c) for c in self.df.columns]
        return Frame(out.select(*named))

    def with_expression(self, name: str, expr: Node | str, scope: str = "global") -> Frame:
        return Frame(with_expression(self.df, name, expr, self._scope(scope)))

    def filter(self, expr: Node | str, scope: str = "global") -> Frame:
        """Keeps the order; positions of the remaining rows are left as they are."""
        return Frame(where_expression(self.df, expr, self._scope(scope)))

    def assign(self, target: str, value: str) -> Frame:
        return Frame(assign(self.df, target, value))

    def split_at(self, row: int) -> tuple[Frame, Frame]:
        """Rows before and from position ``row`` of each partition."""
        return Frame(self.df.where(F.col(POS) < row)), Frame(self.df.where(F.col(POS) >= row))

    def group_ids(self, keys: list[str], name: str = "group_id") -> Frame:
        """Per partition: dense ids of the key tuples in order of first appearance."""
        firsts = self.df.groupBy(PART, *keys).agg(F.min(POS).alias("__first"))
        ids = firsts.withColumn(name, (F.row_number().over(Window.partitionBy(PART).orderBy("__first")) - 1).cast("bigint"))
        ids = ids.select(F.col(PART).alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), name)
        on = [F.col(PART) == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))]
        return Frame(self.df.join(ids, on).drop("__p", *(f"__k{i}" for i in range(len(keys)))))

    def materialize(self, column: str, type_: str | None = None) -> list:
        """The values of one column in order; with ``type_`` the column must have that type."""
        got = dict(self.df.dtypes).get(column)
        if got is None:
            raise ValueError(f"no column {column!r}")
        if type_ is not None and got != type_:
            raise ValueError(f"column {column!r} is {got}, not {type_}")
        return [r[0] for r in self.df.orderBy(PART, POS).select(column).collect()]

    def materialize_text(self) -> list[tuple[str, ...]]:
        ordered = self.df.orderBy(PART, POS)
        return [tuple(r) for r in as_text(ordered, self.columns).collect()]

    def show(self) -> str:
        """Rows as text, one a line, values separated by `` | ``; also printed."""
        out = "\n".join(" | ".join(r) for r in self.materialize_text())
        print(out)
        return out

    @staticmethod
    def _scope(scope: str) -> tuple[str, ...]:
        if scope not in ("global", "partition"):
            raise ValueError("scope is 'global' or 'partition'")
        return (PART,) if scope == "partition" else ()
