"""Window frames.  Bounds are inclusive; each is open, a constant, or an expression of the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import types as Y
from ..compile import Compiler
from ..errors import QueryError
from ..lang.nodes import Node, RangeOf
from ..types import Value
from .order import sort_column


@dataclass(frozen=True)
class Frame:
    """``low`` and ``high`` are numbers or None (open); of a variable frame, values or None."""

    mode: str
    low: object
    high: object
    variable: bool


def read_frame(mode: str, node: Node, c: Compiler) -> Frame:
    if not isinstance(node, RangeOf):
        raise QueryError("a frame is a range", node.start, node.end)
    ends = [None if x is None else c.value(x) for x in (node.low, node.high)]
    for v in ends:
        if v is not None and not Y.is_number(v.type):
            raise QueryError("the bounds of a frame are numbers", node.start, node.end)
    if all(v is None or v.constant for v in ends):
        low, high = (None if v is None else v.literal for v in ends)
        if mode != "range" and any(x is not None and x != int(x) for x in (low, high)):
            raise QueryError("the bounds of a frame of rows are whole", node.start, node.end)
        return Frame(mode, *((x if x is None else float(x) if mode == "range" else int(x)) for x in (low, high)), False)
    return Frame(mode, *ends, True)


#: Blocks of a level hold so many of the level below, as a power of two.
_BITS = 4


def _cover() -> Column:
    """The blocks (lvl, blk) which make up the cells from ``__a`` to ``__b``: at most 30 of each level.

    At each level the whole blocks within count which no whole block of the next
    level holds; beyond the last level there are none.
    """
    edges = []
    for step in (0, 1):
        bits = f"{_BITS} * (l + {step})"
        edges += [f"shiftright(__a + shiftleft(1L, {bits}) - 1L, {bits})", f"(shiftright(__b + 1L, {bits}) - 1L)"]
    a, b, c, d = edges  # the whole blocks of this level and of the next one
    part = lambda x, y: f"if({x} <= {y}, sequence({x}, {y}), array())"
    blocks = f"if({c} <= {d}, concat({part(a, f'shiftleft({c}, {_BITS}) - 1L')}, {part(f'shiftleft({d} + 1L, {_BITS})', b)}), {part(a, b)})"
    return F.expr(f"flatten(transform(sequence(0, {_levels('__b - __a + 1L')}), l -> transform({blocks}, x -> struct(l as lvl, x as blk))))")


def _levels(length: str) -> str:
    """The highest level of which a block may lie within so many cells."""
    return f"(length(hex({length})) - 1)"


def variable_frame(df: DataFrame, calls: list[tuple[str, Value | None, str]], frame: Frame, partition: list[Value], order: list[tuple[Value, str]]) -> DataFrame:
    """A frame whose bounds differ from row to row, for all ``calls`` (function, argument, output) at once.

    Rows are numbered, which sorts each partition of the window in one task (for
    ``groups`` runs of equal values are numbered, for ``range`` distinct values),
    and a row's frame becomes an interval of numbers.  What rows of one number
    are together is aggregated, then what blocks of 16, 256, ... numbers are.  An
    interval is made of a few blocks of each level, which are joined by
    equality, so the work grows with the logarithm of a frame's length.
    """
    from .grouping import with_runs

    name, v, out = calls[0]
    sorts = [sort_column(o.col, f) for o, f in order] or [F.monotonically_increasing_id()]
    keys = [f"{out}p{k}" for k in range(len(partition))]
    for k, p in zip(keys, partition, strict=True):
        df = df.withColumn(k, p.col)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    df = df.withColumn(f"{out}n", F.row_number().over(w.orderBy(*sorts)).cast("long"))
    if frame.mode == "rows":
        df = df.withColumn(f"{out}i", F.col(f"{out}n"))
    elif frame.mode == "groups":
        df = with_runs(df, v, partition, sorts, f"{out}i").withColumn(f"{out}i", F.col(f"{out}i").cast("long"))
    else:
        df = df.withColumn(f"{out}i", v.col.cast("double"))
    whole = frame.mode != "range"
    kind = "long" if whole else "double"
    at = F.col(f"{out}i")

    def bound(x: Value | None, floor: bool) -> Column | None:
        return None if x is None else at + (F.floor(x.col) if whole and floor else F.ceil(x.col) if whole else x.col).cast(kind)

    low, high = bound(frame.low, False), bound(frame.high, True)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.min(at).over(every), F.max(at).over(every)
    df = df.withColumn(f"{out}f", first).withColumn(f"{out}t", last)
    edges = (F.col(f"{out}f"), F.col(f"{out}t"))
    df = df.withColumn(f"{out}a", F.greatest(low, edges[0]) if low is not None else edges[0]).withColumn(f"{out}b", F.least(high, edges[1]) if high is not None else edges[1])
    if name == "first":  # clamped to the rows there are
        df = df.withColumn(f"{out}b", F.greatest(f"{out}b", edges[0]))
    if name == "last":
        df = df.withColumn(f"{out}a", F.least(f"{out}a", edges[1]))
    rank = F.col(f"{out}n")
    # what rows of one number are together
    pre: list[Column] = []
    for i, (fname, x, _) in enumerate(calls):
        value = x.col if x is not None else F.lit(1)
        if fname in ("first", "last"):
            pre += [(F.min_by if fname == "first" else F.max_by)(F.struct(value.alias("v")), rank).alias(f"s{i}"), (F.min if fname == "first" else F.max)(rank).alias(f"r{i}")]
        elif fname == "avg":
            pre += [F.sum(value if Y.is_decimal(x.type) else value.cast("double")).alias(f"s{i}"), F.count(value).alias(f"r{i}")]
        else:
            pre.append(fn.aggregate_column(fname, x).alias(f"s{i}"))

    def joined(i: int, fname: str) -> list[Column]:
        """What several of such are together."""
        if fname in ("first", "last"):
            return [(F.min_by if fname == "first" else F.max_by)(f"s{i}", f"r{i}").alias(f"s{i}"), (F.min if fname == "first" else F.max)(f"r{i}").alias(f"r{i}")]
        if fname == "avg":
            return [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"r{i}").alias(f"r{i}")]
        return [(F.sum if fname in ("count", "sum") else F.min if fname == "min" else F.max)(f"s{i}").alias(f"s{i}")]

    together = [c for i, (fname, _, _) in enumerate(calls) for c in joined(i, fname)]
    cells = df.groupBy(*(F.col(k).alias(f"c{k}") for k in keys), at.alias("cell")).agg(*pre).where("cell is not null")
    asked = df.select(*keys, F.col(f"{out}n").alias("__n"), F.col(f"{out}a").alias("__a"), F.col(f"{out}b").alias("__b")).where("__a <= __b")
    if not whole:
        cells, asked = _by_rank(cells, asked, keys)
    longest = asked.groupBy(*(F.col(k).alias(f"m{k}") for k in keys)).agg(F.max(F.expr("__b - __a + 1L")).alias("__len"))
    at_keys = [F.col(f"c{k}").eqNullSafe(F.col(f"m{k}")) for k in keys]
    levels = F.explode(F.expr(f"transform(sequence(0, {_levels('__len')}), l -> struct(l as lvl, shiftright(cell, {_BITS} * l) as blk))")).alias("block")
    cells = cells.join(longest, at_keys) if keys else cells.crossJoin(F.broadcast(longest))  # without keys that is one row
    blocks = cells.withColumn("block", levels).groupBy(*(f"c{k}" for k in keys), "block").agg(*together)
    same = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys]
    pieces = asked.select(*keys, "__n", F.explode(_cover()).alias("want"))
    found = pieces.join(blocks, [*same, F.col("want") == F.col("block")]).groupBy(*(F.col(k).alias(f"d{k}") for k in keys), F.col("__n").alias(f"{out}d")).agg(*together)
    for i, (fname, _, _) in enumerate(calls):
        total = F.col(f"s{i}").getField("v") if fname in ("first", "last") else F.when(F.col(f"r{i}") > 0, F.col(f"s{i}") / F.col(f"r{i}")) if fname == "avg" else F.col(f"s{i}")
        found = found.withColumn(f"{out}s{i}", total)
    found = found.select(*(f"d{k}" for k in keys), f"{out}d", *(f"{out}s{i}" for i in range(len(calls))))
    back = df.join(found, [*(F.col(k).eqNullSafe(F.col(f"d{k}")) for k in keys), F.col(f"{out}n") == F.col(f"{out}d")], "left")
    for i, (fname, x, column) in enumerate(calls):
        t = fn.result_type(fname, x)
        made = F.col(f"{out}s{i}").cast(t)
        back = back.withColumn(column, F.coalesce(made, F.lit(0).cast(t)) if fname in ("count", "sum") else made)
    return back


def _by_rank(cells: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values and bounds of intervals as places among the distinct values of a partition, found by one sort of all."""
    marks = cells.select(*(F.col(f"c{k}").alias(k) for k in keys), F.col("cell").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("__n"))
    for end, kind in (("__a", 0), ("__b", 2)):  # a lower bound comes before its value, an upper one after it
        marks = marks.unionByName(asked.select(*keys, F.col(end).alias("x"), F.lit(kind).alias("kind"), "__n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("place", F.count(F.when(F.col("kind") == 1, 1)).over(w))
    ranked = marks.where("kind = 1").select(*(F.col(k).alias(f"r{k}") for k in keys), "x", "place")
    cells = cells.join(ranked, [*(F.col(f"c{k}").eqNullSafe(F.col(f"r{k}")) for k in keys), F.col("cell") == F.col("x")]).drop("cell", "x", *(f"r{k}" for k in keys)).withColumnRenamed("place", "cell")
    ends = marks.where("kind <> 1").groupBy(*keys, "__n").agg(F.max(F.when(F.col("kind") == 0, F.col("place") + 1)).alias("__a"), F.max(F.when(F.col("kind") == 2, F.col("place"))).alias("__b"))
    return cells, ends.where("__a <= __b")


__all__ = ["Frame", "read_frame", "variable_frame"]
