"""Syntax trees.  Every node knows its place in the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Node:
    start: int = field(default=-1, kw_only=True, compare=False)
    end: int = field(default=-1, kw_only=True, compare=False)

    def children(self) -> Iterator["Node"]:
        for f in fields(self):
            v = getattr(self, f.name)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, Node):
                    yield x
                elif isinstance(x, tuple):
                    yield from (y for y in x if isinstance(y, Node))

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Literal(Node):
    """``kind``: int, long, big, decimal, float, double, string, boolean or null."""

    value: object
    kind: str


@dataclass(frozen=True)
class Param(Node):
    """An argument; numbered from 1."""

    number: int


@dataclass(frozen=True)
class Path(Node):
    """A column, or a column within rows: ``a.b.c``."""

    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class RangeOf(Node):
    """``low..high``; an open end is None."""

    low: Node | None
    high: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    named: tuple[tuple[str, Node], ...] = ()


@dataclass(frozen=True)
class Item(Node):
    """One projected column; ``expr`` is None for a plain path, ``wild`` for ``*`` or ``path.*``."""

    path: Path | None
    expr: Node | None = None
    hidden: bool = False
    order: str | None = None  # "+", "+!", "-" or "-!"
    wild: bool = False


@dataclass(frozen=True)
class Query(Node):
    """``first`` is None without a projection, ``second`` is None without a semicolon."""

    first: tuple[Item, ...] | None
    second: tuple[Item, ...] | None
    filter: Node | None
    arguments: int = 0


def conjuncts(node: Node | None) -> list[Node]:
    """The terms of a conjunction, with negations pushed inwards first."""
    if node is None:
        return []
    node = negated(node.operand) if isinstance(node, Unary) and node.op == "!" else node
    if isinstance(node, Binary) and node.op == "&&":
        return [*conjuncts(node.left), *conjuncts(node.right)]
    return [node]


_FLIPPED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def negated(node: Node) -> Node:
    """The negation: exact, as comparisons are never unknown."""
    where = {"start": node.start, "end": node.end}
    if isinstance(node, Unary) and node.op == "!":
        return node.operand
    if isinstance(node, Binary) and node.op in ("&&", "||"):
        return Binary("||" if node.op == "&&" else "&&", negated(node.left), negated(node.right), **where)
    if isinstance(node, Binary) and node.op in _FLIPPED:
        return Binary(_FLIPPED[node.op], node.left, node.right, **where)
    return Unary("!", node, **where)
