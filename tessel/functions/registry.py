"""Operator name -> Column builder.

``kind`` is ``scalar``, ``assign`` (the first operand is also the target) or ``aggregate`` (needs keys to be
evaluated as an unordered window). Overloads are Catalyst's business: any type it accepts is accepted here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int | None  # None: one input or more
    build: Callable[..., Column]
    kind: str = "scalar"


_OPERATORS: dict[str, Operator] = {}


def register(name: str, arity: int | None, build: Callable[..., Column], kind: str = "scalar", replace: bool = False) -> Operator:
    """Add an operator. ``build`` gets ``arity`` Columns (any number for None) and returns one; a pandas_udf is fine too."""
    if kind not in ("scalar", "assign", "aggregate"):
        raise ValueError(f"unknown kind {kind!r}")
    if arity is not None and arity < 1:
        raise ValueError("an operator takes one input at least")
    if name in _OPERATORS and not replace:
        raise ValueError(f"operator {name!r} is registered already")
    _OPERATORS[name] = Operator(name, arity, build, kind)
    return _OPERATORS[name]


def lookup(name: str, n_inputs: int) -> Operator:
    if name not in _OPERATORS:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(sorted(_OPERATORS))}")
    op = _OPERATORS[name]
    if not n_inputs or op.arity not in (None, n_inputs):
        raise ValueError(f"{name!r} takes {op.arity or 'one or more'} inputs, not {n_inputs}")
    return op


def names() -> list[str]:
    return sorted(_OPERATORS)


def _case(*xs: Column) -> Column:
    """CASE WHEN x0 THEN x1 WHEN x2 THEN x3 ... ELSE the last one (or NULL) END."""
    if len(xs) < 2:
        raise ValueError("CASE takes a condition and a value at least")
    out = F.when(xs[0], xs[1])
    for i in range(2, len(xs) - 1, 2):
        out = out.when(xs[i], xs[i + 1])
    return out.otherwise(xs[-1]) if len(xs) % 2 else out


register("+", 2, lambda a, b: a + b)
register("+=", 2, lambda a, b: a + b, kind="assign")
register("-", 2, lambda a, b: a - b)
register("*", 2, lambda a, b: a * b)
register("/", 2, lambda a, b: a / b)
register("%", 2, lambda a, b: a % b)
register("==", 2, lambda a, b: a == b)
register("<", 2, lambda a, b: a < b)
register("<=", 2, lambda a, b: a <= b)
register(">", 2, lambda a, b: a > b)
register(">=", 2, lambda a, b: a >= b)
register("AND", 2, lambda a, b: a & b)
register("OR", 2, lambda a, b: a | b)
register("NOT", 1, lambda a: ~a)
register("IS NULL", 1, lambda a: a.isNull())
register("IN", None, lambda a, *xs: a.isin(*xs))
register("BETWEEN", 3, lambda a, low, high: a.between(low, high))
register("LIKE", 2, lambda a, pattern: F.like(a, pattern))
register("CASE", None, _case)
for _name, _type in (("INT", "int"), ("BIGINT", "bigint"), ("DOUBLE", "double"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("DATE", "date"), ("TIMESTAMP", "timestamp")):
    register(_name, 1, lambda a, _type=_type: a.cast(_type))
for _name, _n, _build in (
    ("ABS", 1, F.abs), ("ROUND", 1, F.round), ("FLOOR", 1, F.floor), ("CEIL", 1, F.ceil),
    ("COALESCE", None, F.coalesce), ("NULLIF", 2, F.nullif), ("LEAST", None, F.least), ("GREATEST", None, F.greatest),
    ("UPPER", 1, F.upper), ("LOWER", 1, F.lower), ("TRIM", 1, F.trim), ("LENGTH", 1, F.char_length), ("CONCAT", None, F.concat), ("SUBSTRING", 3, F.substr), ("REPLACE", 3, F.replace),
    ("YEAR", 1, F.year), ("MONTH", 1, F.month), ("DAY", 1, F.dayofmonth), ("DATE_DIFF", 2, F.date_diff),
    ("ARRAY", None, F.array), ("SIZE", 1, F.size), ("ELEMENT_AT", 2, lambda a, i: F.get(a, i - 1)), ("GET_JSON", 2, lambda a, path: F.get_json_object(a, path)),
):
    register(_name, _n, _build)
# A group without a valid value sums to 0, never NULL.
register("SUM", 1, F.sum, kind="aggregate")
register("COUNT", 1, F.count, kind="aggregate")
register("COUNT DISTINCT", 1, lambda x: F.count_distinct(x), kind="aggregate")
register("APPROX COUNT DISTINCT", 1, lambda x: F.approx_count_distinct(x), kind="aggregate")
register("MAX", 1, F.max, kind="aggregate")
register("MIN", 1, F.min, kind="aggregate")
register("AVG", 1, F.avg, kind="aggregate")
