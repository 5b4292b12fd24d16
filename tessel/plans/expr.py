"""Expression trees with placeholders and window scopes, lowered to Spark Columns.

    call("<", call("+", col("a"), slot("x")), lit(16)).expand("x", call("+", col("b"), col("c")))
    call("SUM", col("v")).over("k")          # SUM(v) OVER (PARTITION BY k), frame = the whole partition
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.registry import lookup
from tessel.operators.join import join_groups


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Col(Node):
    name: str


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Slot(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    op: str
    inputs: tuple[Node, ...]
    keys: tuple[Node, ...] = ()

    def over(self, *keys: Node | str) -> Call:
        return replace(self, keys=tuple(_node(k) for k in keys))

    def expand(self, name: str, by: Node | str) -> Call:
        """The tree with the first placeholder ``name`` (depth first) replaced, in inputs and again in keys."""
        new, n = _substitute(self, name, _node(by))
        if not n:
            raise ValueError(f"no placeholder {name!r} in the expression")
        return new  # type: ignore[return-value]

    def expand_const(self, name: str, value: Any) -> Call:
        return self.expand(name, Lit(value))


def col(name: str) -> Col:
    return Col(name)


def lit(value: Any) -> Lit:
    return Lit(value)


def slot(name: str) -> Slot:
    return Slot(name)


def call(op: str, *inputs: Node | str) -> Call:
    lookup(op, len(inputs))  # fails early on an unknown name or arity
    return Call(op, tuple(_node(i) for i in inputs))


def _node(x: Node | str) -> Node:
    return Col(x) if isinstance(x, str) else x


def _first(nodes: tuple[Node, ...], name: str, by: Node) -> tuple[tuple[Node, ...], int]:
    out, n = list(nodes), 0
    for i, node in enumerate(nodes):
        if isinstance(node, Slot) and node.name == name:
            out[i], n = by, 1
        elif isinstance(node, Call):
            out[i], n = _substitute(node, name, by)
        if n:
            break
    return tuple(out), n


def _substitute(node: Call, name: str, by: Node) -> tuple[Call, int]:
    inputs, a = _first(node.inputs, name, by)
    keys, b = _first(node.keys, name, by)
    return replace(node, inputs=inputs, keys=keys), a + b


def _fresh(df: DataFrame, base: str) -> str:
    taken, i = {c.lower() for c in df.columns}, 0
    while any(c.startswith(f"__{base}_{i}") for c in taken):
        i += 1
    return f"__{base}_{i}"


def _columns(*nodes: Node) -> set[str]:
    """Columns that the trees read."""
    return {n.name for n in nodes if isinstance(n, Col)}.union(*(_columns(*n.inputs, *n.keys) for n in nodes if isinstance(n, Call)))


STRATEGIES = ("aggregate", "window")


def with_expression(df: DataFrame, name: str, expr: Node | str, scope: tuple[str, ...] = (), strategy: str = "aggregate") -> DataFrame:
    """``df`` with ``expr`` as column ``name``. ``scope``: columns put before the keys of every aggregate.

    An aggregate with keys has one value for each key tuple, shown in all of its rows. ``strategy`` says how, with equal
    results: ``aggregate`` groups (combined before its exchange, so a hot key costs a row per task) and joins the
    groups back NULL-safely, large ones by a broadcast; ``window`` sends all rows of a key
    to one task, which is one exchange less where nearly every key has few rows. Expressions have to be deterministic.

    An aggregate inside another one or under its keys becomes a column of its own first.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    temps: list[str] = []

    def attach(value: Column, keys: list[Column], zero: bool, reads: set[str]) -> Column:
        nonlocal df
        temps.append(t := _fresh(df, "w"))
        if strategy == "window":
            # A literal key groups nothing; Window.partitionBy() over none is one global group.
            df = df.withColumn(t, value.over(Window.partitionBy(*keys)))
        elif not keys:
            df = df.withColumn(t, df.agg(value.alias(t)).scalar())
        else:
            ours, theirs = [f"{t}_k{i}" for i in range(len(keys))], [f"{t}_g{i}" for i in range(len(keys))]
            df = df.withColumns(dict(zip(ours, keys, strict=True)))
            groups = df.groupBy(*(F.col(k).alias(g) for k, g in zip(ours, theirs, strict=True))).agg(value.alias(t), F.count("*").alias(f"{t}_n"))
            df = join_groups(df, groups, dict(zip(ours, theirs, strict=True)), f"{t}_n", sorted(reads)).drop(*ours)
        return F.coalesce(F.col(t), F.lit(0)) if zero else F.col(t)

    def lower(node: Node) -> Column:
        if isinstance(node, Col):
            return F.col(f"`{node.name}`")
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Slot):
            raise ValueError(f"placeholder {node.name!r} has no value")
        if not isinstance(node, Call):
            raise ValueError(f"not an expression: {node!r}")
        op = lookup(node.op, len(node.inputs))
        if op.kind != "aggregate":
            if node.keys:
                raise ValueError(f"{node.op!r} is no aggregate and takes no keys")
            return op.build(*(lower(i) for i in node.inputs))
        inputs = [lower(i) for i in node.inputs]
        # A literal key groups nothing.
        keys = [*(F.col(f"`{c}`") for c in scope), *(lower(k) for k in node.keys if not isinstance(k, Lit))]
        return attach(op.build(*inputs), keys, node.op == "SUM", _columns(node))

    lowered = lower(_node(expr))
    return df.withColumn(name, lowered).drop(*(t for t in temps if t != name))


def where_expression(df: DataFrame, expr: Node | str, scope: tuple[str, ...] = (), strategy: str = "aggregate") -> DataFrame:
    """Rows for which ``expr`` is true; NULL drops the row. An aggregate inside makes it QUALIFY."""
    t = _fresh(df, "q")
    return with_expression(df, t, expr, scope, strategy).where(F.col(t)).drop(t)


def assign(df: DataFrame, target: str, value: str) -> DataFrame:
    """``target += value``: NULL where either is NULL."""
    if target == value:
        raise ValueError("the target of += can't be its own addend")
    missing = [c for c in (target, value) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.withColumn(target, F.col(f"`{target}`") + F.col(f"`{value}`"))
