"""``derive`` with a semicolon: grouping by aggregates, or windows over groups.

The columns before the semicolon form the groups.  If no call after it has a
frame, calls are aggregates and a group becomes one row; otherwise they are
window functions and every row stays.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import types as Y
from ..compile import Compiler
from ..errors import QueryError
from ..lang.nodes import Call, Item, Node, Path, Query, conjuncts
from ..types import Value
from .order import rank_key, sort_column
from .table import Table, expand, filter_all, paths, plain_names, split
from .window import Frame, read_frame, variable_frame

FRAMES = ("rows", "groups", "range")


def _calls(node: Node | None) -> list[Call]:
    return [n for n in node.walk() if isinstance(n, Call) and n.name in fn.AGGREGATES] if node is not None else []


def derive_grouped(table: Table, q: Query, args: tuple[object, ...]) -> Table:
    first = expand(table, q.first, grouping=True) if q.first else []
    second = expand(table, q.second) if q.second else []
    calls = [c for i in second for c in _calls(i.expr)]
    for i in first:
        if _calls(i.expr):
            raise QueryError("a grouping column cannot hold an aggregate", i.start, i.end)
    windowed = [bool(c.named) for c in calls]
    if any(windowed) and not all(windowed):
        raise QueryError("aggregates and window functions do not mix", calls[0].start, calls[0].end)
    for c in calls:
        if any(_calls(a) for a in c.args):
            raise QueryError("aggregates cannot be nested", c.start, c.end)
    assigned = {i.path.name for i in (*first, *second) if i.expr is not None}
    grouped_names = {i.path.name for i in first}
    before, after = split(conjuncts(q.filter), assigned)
    if calls and not any(windowed):
        # only group columns are left above the grouping; terms on them go below, as all on source columns
        after_only = {i.path.name for i in second if i.expr is not None}
        before += [t for t in after if not plain_names(t) & after_only and paths(t) <= grouped_names and all(i.expr is None for i in first if i.path.name in paths(t))]
        after = [t for t in after if t not in before]
    df = filter_all(table.df, table.compiler(args), before)
    # group columns, computed ones first
    values: dict[str, Value] = {}
    c = Compiler(table.resolve, args, variables=values)
    groups: list[tuple[Item, Value]] = []
    for k, item in enumerate(first):
        v = c.value(item.expr if item.expr is not None else item.path)
        df = df.withColumn(f"__g{k}", v.col)
        v = Value(F.col(f"__g{k}"), v.type, v.nullable)
        values[item.path.name] = v
        groups.append((item, v))
    shown = [i.path.name for i in (*first, *second) if not i.hidden]
    if len(shown) != len(set(shown)):
        twice = next(n for n in shown if shown.count(n) > 1)
        raise QueryError(f"{twice} is projected twice")
    if calls and not any(windowed):
        return _aggregated(table, df, groups, second, after, args)
    return _windowed(table, df, groups, second, after, args)


def _aggregated(table: Table, df: DataFrame, groups: list[tuple[Item, Value]], second: list[Item], after: list[Node], args: tuple[object, ...]) -> Table:
    group_values = {i.path.name: v for i, v in groups}
    source = Compiler(table.resolve, args, variables=group_values)
    # ordering within groups: flagged columns before the first aggregate
    inner: list[tuple[Value, str]] = []
    for item in second:
        if _calls(item.expr):
            break
        if item.order:
            inner.append((source.value(item.expr if item.expr is not None else item.path), item.order))
    ties = [(table.resolve(Path((k,))), "+") for k in table.key]
    order = [*inner, *([] if inner else [(table.resolve(Path((n,))), f) for n, f in table.order if n in table.columns]), *ties]
    aggregates: dict[Call, str] = {}
    columns: list[Column] = []
    partition = [v.col for _, v in groups] or [F.lit(1)]

    def call(node: Call) -> Value:
        nonlocal df
        if node.name not in fn.AGGREGATES:
            raise QueryError(f"unknown function: {node.name}", node.start, node.end)
        if len(node.args) > 1:
            raise QueryError(f"{node.name} takes one argument", node.start, node.end)
        v = source.value(node.args[0]) if node.args else None
        fn.check_argument(node.name, v, node)
        if node not in aggregates:
            name = aggregates[node] = f"__a{len(aggregates)}"
            if node.name in ("first", "last"):
                key = rank_key(order) if order else None
                if not order:
                    columns.append((F.first if node.name == "first" else F.last)(v.col).alias(name))
                elif key is not None:
                    columns.append((F.min_by if node.name == "first" else F.max_by)(v.col, key).alias(name))
                else:
                    over = Window.partitionBy(*partition).orderBy(*(sort_column(o.col, f) for o, f in order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                    df = df.withColumn(f"{name}w", (F.first if node.name == "first" else F.last)(v.col).over(over))
                    columns.append(F.first(f"{name}w").alias(name))
            else:
                columns.append(fn.aggregate_column(node.name, v).alias(name))
        nullable = node.name not in ("count", "sum") and (v.nullable or False)
        return Value(fn.finish(node.name, v, F.col(aggregates[node])), fn.result_type(node.name, v), nullable)

    variables: dict[str, Value] = dict(group_values)

    def group_only(path: Path) -> Value:
        for item, v in groups:
            if item.expr is None and item.path.parts == path.parts:
                return v
        raise QueryError(f"{path.name} is neither grouped nor aggregated", path.start, path.end)

    c = Compiler(group_only, args, call=call, variables=variables)
    outputs = [(i, v) for i, v in groups]
    seen_call = False
    for item in second:
        own = bool(_calls(item.expr))
        if item.order and not seen_call and not own and not (item.expr is None and item.path.name in variables):
            continue  # orders rows within the group only
        seen_call = seen_call or own
        v = c.value(item.expr if item.expr is not None else item.path)
        variables[item.path.name] = v
        outputs.append((item, v))
    keys = [v.col for _, v in groups]
    grouped = df.groupBy(*(keys or [F.lit(1).alias("__all")])).agg(*columns) if columns else df.select(*keys).distinct()
    grouped = filter_all(grouped, c, after)
    orders = [(v, i.order) for i, v in outputs if i.order]
    if orders:
        grouped = grouped.orderBy(*(sort_column(v.col, f) for v, f in orders), *(k.asc_nulls_last() for k in keys))
    shown = [(i.path.name, v) for i, v in outputs if not i.hidden]
    out = grouped.select(*(v.col.alias(n) for n, v in shown))
    names = [i.path.name for i, _ in groups]
    key = names if names and all(not i.hidden for i, _ in groups) and not any(v.nullable for _, v in groups) else ()
    return Table(out, key, [n for n, v in shown if not v.nullable], tuple((i.path.name, i.order) for i, _ in outputs if i.order and not i.hidden))


def _windowed(table: Table, df: DataFrame, groups: list[tuple[Item, Value]], second: list[Item], after: list[Node], args: tuple[object, ...]) -> Table:
    variables: dict[str, Value] = {i.path.name: v for i, v in groups}
    plain = Compiler(table.resolve, args, variables=variables)
    # the order of rows: flagged columns after the semicolon that hold no window function
    flagged: list[tuple[Item, Value]] = []
    for item in second:
        if item.order and not _calls(item.expr):
            flagged.append((item, plain.value(item.expr if item.expr is not None else item.path)))
    ties = [(table.resolve(Path((k,))), "+") for k in table.key]
    order = [*((v, i.order) for i, v in flagged), *([] if flagged else [(table.resolve(Path((n,))), f) for n, f in table.order if n in table.columns]), *ties]
    partition = [v for _, v in groups]
    made: dict[Call, Value] = {}
    every_call = [c for i in second for c in _calls(i.expr)]

    def call(node: Call) -> Value:
        nonlocal df
        if node.name not in fn.AGGREGATES:
            raise QueryError(f"unknown function: {node.name}", node.start, node.end)
        if len(node.named) != 1 or node.named[0][0] not in FRAMES or len(node.args) > 1:
            raise QueryError("a window function takes one argument and one frame", node.start, node.end)
        if node not in made:
            v = plain.value(node.args[0]) if node.args else None
            fn.check_argument(node.name, v, node)
            frame = read_frame(node.named[0][0], node.named[0][1], plain)
            first_order = flagged[0] if flagged else None
            name = f"__w{len(made)}"
            if frame.mode == "range" and (first_order is None or v is None or not Y.is_number(v.type) or not _same(node.args[0], first_order[0])):
                raise QueryError("a range frame needs a number which is the first ordered column", node.start, node.end)
            if frame.variable:
                # all functions over the same frame are computed together
                alike = [node]
                if node.name not in ("first", "last"):
                    alike += [c for c in every_call if c != node and c not in made and c.named == node.named and c.name not in ("first", "last") and (frame.mode == "rows" or c.args == node.args)]
                todo = []
                for k, other in enumerate(dict.fromkeys(alike)):
                    argument = plain.value(other.args[0]) if other.args else None
                    fn.check_argument(other.name, argument, other)
                    todo.append((other.name, argument, f"{name}c{k}"))
                    made[other] = Value(F.col(f"{name}c{k}"), fn.result_type(other.name, argument), other.name not in ("count", "sum"))
                df = variable_frame(df, todo, frame, partition, order)
                return made[node]
            by_value = frame.mode == "range" or (frame.mode == "groups" and first_order is not None and v is not None and _same(node.args[0], first_order[0]))
            if by_value and (frame.low is not None or frame.high is not None):
                alike = [node, *(c for c in every_call if c != node and c not in made and c.named == node.named and c.args == node.args)]
                todo = []
                for k, other in enumerate(dict.fromkeys(alike)):
                    fn.check_argument(other.name, v, other)
                    todo.append((other.name, v, f"{name}c{k}"))
                    made[other] = Value(F.col(f"{name}c{k}"), fn.result_type(other.name, v), other.name not in ("count", "sum"))
                df = _by_value(df, todo, frame, partition, order)
                return made[node]
            df = _constant_frame(df, node.name, v, frame, partition, order, name)
            nullable = node.name not in ("count", "sum")
            made[node] = Value(F.col(name), fn.result_type(node.name, v), nullable)
        return made[node]

    c = Compiler(table.resolve, args, call=call, variables=variables)
    outputs = list(groups)
    for k, item in enumerate(second):
        v = c.value(item.expr if item.expr is not None else item.path)
        if item.expr is not None:
            df = df.withColumn(f"__v{k}", v.col)
            v = Value(F.col(f"__v{k}"), v.type, v.nullable)
            variables[item.path.name] = v
        outputs.append((item, v))
    df = filter_all(df, c, after)
    shown = [(i.path.name, v) for i, v in outputs if not i.hidden]
    out = df.select(*(v.col.alias(n) for n, v in shown))
    names = {n for n, _ in shown}
    return Table(out, table.key if table.key and set(table.key) <= names else (), [n for n, v in shown if not v.nullable])


def _same(node: Node, item: Item) -> bool:
    return node == item.expr or (isinstance(node, Path) and node.name == item.path.name)


def _over(partition: list[Value], sorts: list[Column]):
    w = Window.partitionBy(*(p.col for p in partition)) if partition else Window.partitionBy(F.lit(1))
    return w.orderBy(*sorts) if sorts else w


def _constant_frame(df: DataFrame, name: str, v: Value | None, frame: Frame, partition: list[Value], order: list[tuple[Value, str]], out: str) -> DataFrame:
    sorts = [sort_column(o.col, f) for o, f in order]
    low = Window.unboundedPreceding if frame.low is None else int(frame.low)
    high = Window.unboundedFollowing if frame.high is None else int(frame.high)
    if frame.mode == "rows" or (frame.low is None and frame.high is None):
        if not sorts and (frame.low is not None or frame.high is not None):
            sorts = [F.monotonically_increasing_id()]
        whole = frame.low is None and frame.high is None and name not in ("first", "last")
        w = _over(partition, [] if whole else sorts).rowsBetween(low, high)
        if name not in ("first", "last"):
            return df.withColumn(out, fn.finish(name, v, fn.aggregate_column(name, v).over(w)))
        # the place is clamped to the rows there are
        column = (F.first if name == "first" else F.last)(v.col).over(w)
        whole_w = _over(partition, sorts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if name == "first" and frame.high is not None and frame.high < 0:
            column = F.when(F.count(F.lit(1)).over(w) == 0, F.first(v.col).over(whole_w)).otherwise(column)
        if name == "last" and frame.low is not None and frame.low > 0:
            column = F.when(F.count(F.lit(1)).over(w) == 0, F.last(v.col).over(whole_w)).otherwise(column)
        return df.withColumn(out, column)
    df = with_runs(df, v, partition, sorts, f"{out}r")
    return _by_number(df, name, v, frame, partition, F.col(f"{out}r"), order, out)


def with_runs(df: DataFrame, v: Value, partition: list[Value], sorts: list[Column], out: str) -> DataFrame:
    """Number the runs of equal values, from 1, in the order of rows."""
    if v is None:
        raise QueryError("a groups frame needs an argument")
    w = _over(partition, sorts or [F.monotonically_increasing_id()])
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(v.col.eqNullSafe(F.lag(v.col).over(w)), 0).otherwise(1))
    return df.withColumn(f"{out}n", new).withColumn(out, F.sum(f"{out}n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop(f"{out}n")


def _ends(frame: Frame) -> str:
    """A constant frame's bounds in SQL."""
    ends = []
    for x, side in ((frame.low, "preceding"), (frame.high, "following")):
        ends.append(f"unbounded {side}" if x is None else f"{-x!r} preceding" if x < 0 else f"{x!r} following" if x else "current row")
    return " and ".join(ends)


_SORTS = {"+": "asc nulls last", "+!": "asc nulls first", "-": "desc nulls first", "-!": "desc nulls last"}


def _by_value(df: DataFrame, calls: list[tuple[str, Value, str]], frame: Frame, partition: list[Value], order: list[tuple[Value, str]]) -> DataFrame:
    """A frame over the values of the first ordered column, for all ``calls`` (function, argument, output) at once.

    Rows with one value have one frame.  They are aggregated first, so that the
    window sorts a group's distinct values and not its rows; its results are
    joined to the rows by value.  Bounds of a range are numeric whichever way
    rows are ordered.
    """
    _, v, out = calls[0]
    by_range, falling = frame.mode == "range", order[0][1].startswith("-")
    keys = [f"{out}p{k}" for k in range(len(partition))]
    for k, p in zip([*keys, f"{out}x"], [*(p.col for p in partition), v.col.cast("double") if by_range else v.col], strict=True):
        df = df.withColumn(k, p)
    ties = rank_key(order[1:]) if len(order) > 1 else None
    pre: list[Column] = []
    for i, (name, _, _) in enumerate(calls):
        if name in ("first", "last"):
            row = F.struct(v.col.alias("v"))
            pre.append((F.first(row) if ties is None else (F.min_by if name == "first" else F.max_by)(row, ties)).alias(f"{out}s{i}"))
        elif name == "avg":
            pre += [F.sum(v.col if Y.is_decimal(v.type) else v.col.cast("double")).alias(f"{out}s{i}"), F.count(v.col).alias(f"{out}r{i}")]
        else:
            pre.append(fn.aggregate_column(name, v).alias(f"{out}s{i}"))
    cells = df.groupBy(*(F.col(k).alias(f"{k}c") for k in [*keys, f"{out}x"])).agg(*pre)
    by = f"partition by {', '.join(f'{k}c' for k in keys)} " if keys else ""
    over = f"over ({by}order by {out}xc {'range' if by_range else _SORTS[order[0][1]] + ' rows'} between {_ends(frame)})"
    found = []
    for i, (name, _, column) in enumerate(calls):
        t = fn.result_type(name, v)
        if name in ("first", "last"):
            made = F.expr(f"{'first' if (name == 'first') != (by_range and falling) else 'last'}({out}s{i}) {over}").getField("v")
        elif name == "avg":
            made = F.expr(f"sum({out}s{i}) {over}") / F.expr(f"nullif(sum({out}r{i}) {over}, 0)")
            if Y.is_decimal(v.type):
                made = made.cast(T.DecimalType(min(38, v.type.precision + 4), min(38, v.type.scale + 4)))  # as avg rounds
        else:
            made = F.expr(f"{name if name in ('min', 'max') else 'sum'}({out}s{i}) {over}")
        found.append((F.coalesce(made.cast(t), F.lit(0).cast(t)) if name in ("count", "sum") else made.cast(t)).alias(column))
    cells = cells.select(*(f"{k}c" for k in [*keys, f"{out}x"]), *found)
    return df.join(cells, [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in [*keys, f"{out}x"]], "left")


def _by_number(df: DataFrame, name: str, v: Value, frame: Frame, partition: list[Value], number: Column, order: list[tuple[Value, str]], out: str) -> DataFrame:
    """A frame over the numbers of runs."""
    df = df.withColumn(f"{out}x", number.cast("double")).withColumn(f"{out}y", v.col)
    keys = []
    for k, p in enumerate(partition):
        df = df.withColumn(f"{out}p{k}", p.col)
        keys.append(f"{out}p{k}")
    over = f"over ({'partition by ' + ', '.join(keys) if keys else ''} order by {out}x range between {_ends(frame)})"
    if name in ("first", "last"):
        ties = rank_key(order[1:]) if len(order) > 1 else None
        df = df.withColumn(f"{out}k", F.struct(F.col(f"{out}x").alias("x"), *([ties.alias("t")] if ties is not None else [])))
        column = F.expr(f"{'min_by' if name == 'first' else 'max_by'}({out}y, {out}k) {over}")
    else:
        t = {"count": "count({0})", "sum": f"sum(cast({{0}} as {fn.result_type('sum', v).simpleString()}))", "avg": "avg({0})" if Y.is_decimal(v.type) else "avg(cast({0} as double))", "min": "min({0})", "max": "max({0})"}[name]
        column = fn.finish(name, v, F.expr(f"{t.format(f'{out}y')} {over}"))
    return df.withColumn(out, column)


__all__ = ["derive_grouped", "with_runs"]
