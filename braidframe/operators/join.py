"""Joins by a spec: ``emp >: dept``, ``a : (b >< c)``.

``:`` inner, ``::`` inner (straight), ``>:`` left, ``:<`` right, ``>:<`` full outer,
``>`` left anti, ``<`` right anti, ``><`` full anti.  A joined row has one column
per table, which holds that table's row or null.

The filter is split: a term that needs one side only goes into that side, so on
a side that may be missing it works like ON; terms on both sides are the join
condition; what is left above works like WHERE.  A missing row on a term's path
fails the term.

Columns of the tables are kept flat beneath, so projections prune them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..compile import Compiler
from ..errors import QueryError
from ..lang import parse_query
from ..lang.nodes import Node, Path, Query, conjuncts
from ..types import Value
from .table import Table, paths, plain_names

_OPS = ("><", ">:<", ">:", ":<", "::", ":", ">", "<")
_TOKEN = re.compile(r"\s*(>:<|><|>:|:<|::|:|>|<|\(|\)|[A-Za-z_$][\w$]*)")
#: operator -> (Spark's join type, whether the left and right rows may be missing)
_KINDS = {":": ("inner", False, False), "::": ("inner", False, False), ">:": ("left", False, True), ":<": ("right", True, False), ">:<": ("full", True, True)}


@dataclass(frozen=True)
class Leaf:
    name: str

    def names(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class Pair:
    op: str
    left: "Leaf | Pair"
    right: "Leaf | Pair"

    def names(self) -> list[str]:
        return [*self.left.names(), *self.right.names()]


def parse_spec(spec: str) -> Leaf | Pair:
    tokens, at = [], 0
    text = spec.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"bad join spec: {spec}", at, len(text))
        tokens.append(m[1])
        at = m.end()
    place = 0

    def primary() -> Leaf | Pair:
        nonlocal place
        if place >= len(tokens):
            raise QueryError(f"bad join spec: {spec}")
        token = tokens[place]
        place += 1
        if token == "(":
            inner = chain()
            if place >= len(tokens) or tokens[place] != ")":
                raise QueryError(f"bad join spec: {spec}")
            place += 1
            return inner
        if token in _OPS or token == ")":
            raise QueryError(f"bad join spec: {spec}")
        return Leaf(token)

    def chain() -> Leaf | Pair:
        nonlocal place
        left = primary()
        while place < len(tokens) and tokens[place] in _OPS:
            op = tokens[place]
            place += 1
            left = Pair(op, left, primary())
        return left

    tree = chain()
    if place != len(tokens):
        raise QueryError(f"bad join spec: {spec}")
    if len(set(tree.names())) != len(tree.names()):
        raise QueryError("a join names each table once")
    return tree


@dataclass(frozen=True)
class _Side:
    df: DataFrame
    missing: frozenset[str]  # tables whose row may be missing


class JoinTable(Table):
    """A join before its filter is known; a query decides where the filter's terms go."""

    def __init__(self, tree: Leaf | Pair, tables: dict[str, Table], terms: tuple[tuple[Node, tuple[object, ...]], ...] = ()) -> None:
        self._tree, self._tables, self._terms = tree, tables, terms
        side = self._build(tree, list(terms))
        self._flat, self._missing = side.df, side.missing
        super().__init__(self._structs(side), (), [n for n in tree.names() if n not in side.missing])

    # flat names: one column per table column, and one that tells whether the row is there

    def _leaf(self, name: str) -> DataFrame:
        t = self._tables[name]
        return t.df.select(*(F.col(f"`{c}`").alias(f"{name}.{c}") for c in t.columns), F.lit(True).alias(f"{name}?"))

    def _value(self, path: Path, missing: frozenset[str]) -> Value:
        name = path.parts[0]
        if name not in self._tables:
            raise QueryError(f"no such column: {path.name}", path.start, path.end)
        table = self._tables[name]
        there = F.col(f"`{name}?`")
        if len(path.parts) == 1:
            row = F.struct(*(F.col(f"`{name}.{c}`").alias(c) for c in table.columns))
            return Value(F.when(there, row) if name in missing else row, table.row_type, name in missing)
        inner = table.resolve(Path(path.parts[1:], start=path.start, end=path.end))
        col = F.col(f"`{name}.{path.parts[1]}`")
        for part in path.parts[2:]:
            col = col.getField(part)
        guards = (there.isNotNull(),) if name in missing else ()
        return Value(col, inner.type, inner.nullable or name in missing, guards=guards)

    def resolve(self, path: Path) -> Value:
        return self._value(path, self._missing) if hasattr(self, "_missing") else super().resolve(path)

    def _structs(self, side: _Side) -> DataFrame:
        return side.df.select(*(self._value(Path((n,)), side.missing).col.alias(n) for n in self._tree.names()))

    def _condition(self, term: Node, args: tuple[object, ...], missing: frozenset[str]) -> Column:
        c = Compiler(lambda p: self._value(p, missing), args)
        v = c.value(term)
        condition = c.condition(term)
        return reduce(lambda a, b: a & b, v.guards, condition)

    def _build(self, node: Leaf | Pair, terms: list[tuple[Node, tuple[object, ...]]]) -> _Side:
        if isinstance(node, Leaf):
            df = self._leaf(node.name)
            for term, args in terms:
                df = df.where(self._condition(term, args, frozenset()))
            return _Side(df, frozenset())
        names = set(node.left.names()), set(node.right.names())
        own: tuple[list, list] = ([], [])
        both = []
        for t in terms:
            used = paths(t[0])
            place = 0 if used <= names[0] else 1 if used <= names[1] else 2
            (both if place == 2 or not used else own[place]).append(t)
        left, right = self._build(node.left, own[0]), self._build(node.right, own[1])
        missing = left.missing | right.missing
        conditions = [self._condition(t, args, missing) for t, args in both]
        on = reduce(lambda a, b: a & b, conditions) if conditions else None
        if node.op in _KINDS:
            kind, left_goes, right_goes = _KINDS[node.op]
            if on is None and kind == "inner":
                df = left.df.crossJoin(right.df)
            else:
                df = left.df.join(right.df, on if on is not None else F.lit(True), kind)
            return _Side(df, missing | (frozenset(names[0]) if left_goes else frozenset()) | (frozenset(names[1]) if right_goes else frozenset()))
        on = on if on is not None else F.lit(True)
        parts = []
        if node.op in (">", "><"):
            parts.append(self._padded(left.df.join(right.df, on, "left_anti"), right.df))
        if node.op in ("<", "><"):
            parts.append(self._padded(right.df.join(left.df, on, "left_anti"), left.df))
        order = [*left.df.columns, *right.df.columns]
        df = reduce(lambda a, b: a.unionByName(b), parts).select(*(f"`{c}`" for c in order))
        gone = frozenset(names[1] if node.op in (">", "><") else ()) | frozenset(names[0] if node.op in ("<", "><") else ())
        return _Side(df, missing | gone)

    @staticmethod
    def _padded(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.select(*(f"`{c}`" for c in df.columns), *(F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields))

    # queries

    def derive(self, query: str, *args: object) -> Table:
        q = parse_query(query)
        assigned = {i.path.name for i in (*(q.first or ()), *(q.second or ())) if i.expr is not None}
        terms = conjuncts(q.filter)
        own = [t for t in terms if not plain_names(t) & assigned]
        rest = [t for t in terms if t not in own]
        narrowed = JoinTable(self._tree, self._tables, (*self._terms, *((t, args) for t in own))) if own else self
        if q.first is None and not rest:
            return narrowed
        left = Query(q.first, q.second, _all(rest), q.arguments)
        # over the flat columns, so that projections reach the scans
        view = _FlatView(narrowed)
        if q.second is not None:
            from .grouping import derive_grouped

            return derive_grouped(view, left, args)
        return view._derive_plain(left, args)

    query = derive


class _FlatView(Table):
    """A join as a table whose rows are the flat columns; paths still go through the tables' names."""

    def __init__(self, joined: JoinTable) -> None:
        self._joined = joined
        super().__init__(joined._flat)

    def resolve(self, path: Path) -> Value:
        return self._joined.resolve(path)

    @property
    def columns(self) -> list[str]:
        return self._joined._tree.names()


def _all(terms: list[Node]) -> Node | None:
    from ..lang.nodes import Binary

    return reduce(lambda a, b: Binary("&&", a, b), terms) if terms else None


def join(spec: str, *tables: Table, **named: Table) -> JoinTable:
    """Join tables by a spec; tables come in the order of the spec's names, or by name."""
    tree = parse_spec(spec)
    names = tree.names()
    if tables:
        if named or len(tables) != len(names):
            raise QueryError(f"the spec names {len(names)} tables")
        named = dict(zip(names, tables, strict=True))
    absent = [n for n in names if n not in named]
    if absent:
        raise QueryError(f"no table for {absent[0]}")
    return JoinTable(tree, {n: named[n] for n in names})


def join_identity(spark: SparkSession) -> Table:
    """One row without columns: scalar queries run on it."""
    return Table(spark.range(1).select())


__all__ = ["JoinTable", "join", "join_identity", "parse_spec"]
