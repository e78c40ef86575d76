"""``Table``: a DataFrame with its primary key and the columns that hold no null.

Verbs build new tables; nothing runs before an action.  The primary key breaks
ties wherever the order of rows shows in a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as Y
from ..compile import Compiler
from ..errors import QueryError, UnsetColumn
from ..lang import parse_query
from ..lang.nodes import Item, Node, Path, Query, conjuncts
from ..types import Value
from .order import parse_spec, sort_column


class Table:
    def __init__(self, df: DataFrame, key: Iterable[str] = (), non_null: Iterable[str] = (), order: tuple[tuple[str, str], ...] = ()) -> None:
        self.df, self.key, self.order = df, tuple(key), order
        declared = {f.name for f in df.schema.fields if not f.nullable}
        self.non_null = frozenset(declared | set(non_null) | set(self.key))
        self._fields = {f.name: f for f in df.schema.fields}
        unknown = (set(self.key) | set(non_null)) - set(self._fields)
        if unknown:
            raise QueryError(f"no such column: {sorted(unknown)[0]}")

    # columns

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def row_type(self) -> T.StructType:
        return self.df.schema

    def resolve(self, path: Path) -> Value:
        """The column that a path names; a path through a missing row gives null."""
        f = self._fields.get(path.parts[0])
        if f is None:
            raise QueryError(f"no such column: {path.name}", path.start, path.end)
        col, t, nullable, guards = F.col(f"`{f.name}`"), f.dataType, f.name not in self.non_null, []
        for part in path.parts[1:]:
            if not isinstance(t, T.StructType) or part not in t.names:
                raise QueryError(f"no such column: {path.name}", path.start, path.end)
            if nullable:
                guards.append(col.isNotNull())
            inner = t[part]
            col, t, nullable = col.getField(part), inner.dataType, nullable or inner.nullable
        return Value(col, t, nullable, guards=tuple(guards))

    def sub_columns(self, path: Path) -> list[str]:
        t = self.resolve(path).type
        if not isinstance(t, T.StructType):
            raise QueryError(f"{path.name} holds no columns", path.start, path.end)
        return t.names

    def compiler(self, args: tuple[object, ...] = (), **more) -> Compiler:
        return Compiler(self.resolve, args, **more)

    # queries

    def derive(self, query: str, *args: object) -> "Table":
        """A table by a query: ``{projection ; projection} filter``."""
        from .grouping import derive_grouped

        q = parse_query(query)
        if q.second is not None:
            return derive_grouped(self, q, args)
        return self._derive_plain(q, args)

    query = derive

    def query_all(self) -> "Table":
        return self.derive("{*}")

    def _derive_plain(self, q: Query, args: tuple[object, ...]) -> "Table":
        df = self.df
        assigned = {i.path.name for i in q.first or () if i.expr is not None}
        before, after = split(conjuncts(q.filter), assigned)
        c = self.compiler(args)
        df = filter_all(df, c, before)
        if q.first is None:
            df = filter_all(df, c, after)
            return Table(df, self.key, self.non_null, self.order)
        items = expand(self, q.first)
        values: dict[str, Value] = {}
        c = Compiler(self.resolve, args, variables=values)
        shown: list[str] = []
        outputs: list[tuple[str, Value]] = []
        orders: list[tuple[Value, str]] = []
        for k, item in enumerate(items):
            name = item.path.name
            if item.expr is None:
                v = c.value(item.path)
            else:
                v = c.value(item.expr)
                if isinstance(v.type, T.NullType):
                    v = Value(v.col, Y.NULL)
                df = df.withColumn(f"__v{k}", v.col)
                v = Value(F.col(f"__v{k}"), v.type, v.nullable, v.literal, v.constant, v.guards)
                values[name] = v
            if item.order:
                orders.append((v, item.order))
            if not item.hidden:
                if name in shown:
                    raise QueryError(f"{name} is projected twice", item.start, item.end)
                shown.append(name)
                outputs.append((name, v))
        df = filter_all(df, c, after)
        ties = [(Value(F.col(f"`{k}`"), self._fields[k].dataType, False), "+") for k in self.key] if orders else []
        if orders:
            df = df.orderBy(*(sort_column(v.col, flag) for v, flag in [*orders, *ties]))
        df = df.select(*(v.col.alias(name) for name, v in outputs))
        plain = {i.path.name for i in items if i.expr is None and not i.hidden}
        key = self.key if self.key and set(self.key) <= plain else ()
        non_null = [n for n, v in outputs if not v.nullable]
        flags = tuple((i.path.name, i.order) for i in items if i.order)
        return Table(df, key, non_null, flags)

    def predicate(self, query: str, *args: object) -> Column:
        """A filter as a Spark column over this table's DataFrame."""
        q = parse_query(query)
        if q.first is not None or q.filter is None:
            raise QueryError("a predicate is a filter only")
        return self.compiler(args).condition(q.filter)

    def comparator(self, spec: str) -> list[Column]:
        """Sort columns of a spec such as ``+a-b``."""
        return [sort_column(self.resolve(Path(tuple(name.split(".")))).col, flag) for name, flag in parse_spec(spec)]

    def sorted(self, spec: str) -> "Table":
        ties = [F.col(f"`{k}`").asc() for k in self.key]
        return Table(self.df.orderBy(*self.comparator(spec), *ties), self.key, self.non_null, tuple(parse_spec(spec)))

    def scan(self, reverse: bool = False) -> DataFrame:
        """All rows in order of the primary key."""
        return self.df.orderBy(*(F.col(f"`{k}`").desc() if reverse else F.col(f"`{k}`").asc() for k in self.key)) if self.key else self.df

    def top(self, n: int, spec: str) -> "Table":
        return Table(self.sorted(spec).df.limit(n), self.key, self.non_null)

    def skip(self, n: int, spec: str) -> "Table":
        """All but the first ``n`` rows of an order; a negative ``n`` leaves out the last ones."""
        if n >= 0:
            return Table(self.sorted(spec).df.offset(n), self.key, self.non_null)
        flipped = "".join({"+": "-", "-": "+", "+!": "-!", "-!": "+!"}[f] + f"`{c}`" for c, f in parse_spec(spec))
        return Table(Table(self.df, (), self.non_null).sorted(flipped).df.offset(-n), self.key, self.non_null)

    def seek(self, how: str, **key: object) -> DataFrame:
        """One row next to a key of one or more columns: ``first last eq ge gt le lt``."""
        names = list(key) or list(self.key)
        columns = [F.col(f"`{n}`") for n in names]
        rows = self.df
        if key:
            values = [F.lit(v).cast(self._fields[n].dataType) for n, v in key.items()]
            here, there = F.struct(*columns), F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))
            test = {"eq": here == there, "ge": here >= there, "gt": here > there, "le": here <= there, "lt": here < there}.get(how)
            if test is not None:
                # the leading column's bound reaches the scan
                rows = rows.where(columns[0] >= values[0] if how in ("ge", "gt") else columns[0] <= values[0] if how in ("le", "lt") else columns[0] == values[0]).where(test)
        down = how in ("last", "le", "lt")
        order = [*columns, *(F.col(f"`{k}`") for k in self.key if k not in names)]
        return rows.orderBy(*(c.desc() if down else c.asc() for c in order)).limit(1)

    def random_row(self, query: str = "", *args: object, seed: int | None = None) -> DataFrame:
        """One row drawn evenly from those that a filter, such as a range of keys, takes."""
        rows = self.df.where(self.predicate(query, *args)) if query else self.df
        return rows.orderBy(F.rand(seed)).limit(1)

    # single rows and tests

    def _by_key(self, key: Mapping[str, object]) -> DataFrame:
        return reduce(lambda df, kv: df.where(F.col(f"`{kv[0]}`").eqNullSafe(F.lit(kv[1]))), key.items(), self.df)

    def load(self, **key: object) -> Row:
        row = self.try_load(**key)
        if row is None:
            raise KeyError(f"no such row: {key}")
        return row

    def try_load(self, **key: object) -> Row | None:
        return next(iter(self._by_key(key).take(1)), None)

    def exists(self, **key: object) -> bool:
        return bool(self._by_key(key).select(F.lit(1)).take(1))

    def any_rows(self, query: str = "", *args: object) -> bool:
        return bool((self.derive(query, *args) if query else self).df.take(1))

    def is_empty(self) -> bool:
        return not self.any_rows()

    def rows(self) -> Iterator[Row]:
        """Rows one by one, partition after partition."""
        return self.df.toLocalIterator()

    def get(self, row: Row, name: str) -> object:
        if name not in row.__fields__:
            raise UnsetColumn(name)
        return row[name]

    # verbs

    def distinct(self) -> "Table":
        return self if self.key else Table(self.df.distinct(), (), self.non_null)

    def empty(self) -> "Table":
        return Table(self.df.limit(0), self.key, self.non_null)

    def as_type(self, schema: T.StructType, key: Iterable[str] = ()) -> "Table":
        """Columns by name as another type, without failing: see ``types.lossy``; missing ones get defaults."""
        return Table(self.df.select(*(self._lossy(f) for f in schema.fields)), key, [f.name for f in schema.fields if not f.nullable])

    def _lossy(self, f: T.StructField) -> Column:
        if f.name not in self._fields:
            empty = F.lit(None).cast(f.dataType) if f.nullable else Y.default_of(f.dataType)
            return empty.alias(f.name)
        return Y.lossy(self.resolve(Path((f.name,))), f.dataType, f.nullable).alias(f.name)

    def as_exact(self, schema: T.StructType) -> "Table":
        """Columns by name as another type; a loss is an error when rows are read."""
        missing = [f.name for f in schema.fields if f.name not in self._fields]
        if missing:
            raise QueryError(f"no such column: {missing[0]}")
        return Table(self.df.select(*(Y.exact(self.resolve(Path((f.name,))), f.dataType).alias(f.name) for f in schema.fields)))

    def derive_as(self, schema: T.StructType, query: str, *args: object) -> "Table":
        """``derive`` whose projection must fit a declared type."""
        out = self.derive(query, *args)
        extra = [n for n in out.columns if n not in schema.names]
        if extra:
            raise QueryError(f"the target type has no column {extra[0]}")
        fields = [f for f in schema.fields if f.name in out.columns]
        for f in fields:
            v = out.resolve(Path((f.name,)))
            if v.nullable and not f.nullable and f.name in out.non_null:
                raise QueryError(f"{f.name} takes no null")
            if v.type != f.dataType and Y.is_number(v.type) != Y.is_number(f.dataType) and not isinstance(f.dataType, T.StringType):
                raise QueryError(f"{f.name} cannot be {f.dataType.simpleString()}")
        return out.as_exact(T.StructType(fields))

    def map(self, fn: Callable[[Row], Mapping[str, object] | None], schema: T.StructType, source: Iterable[str] | None = None, inverse: Mapping[str, str] | None = None, batches: bool = False) -> "MappedTable":
        """Each row to one or none by a Python function, which sees the columns ``source`` only.

        With ``batches`` the function takes and gives Arrow record batches, which is much faster.

        ``inverse`` maps target columns to the source columns that they equal; filters on
        those go below the function.
        """
        return MappedTable(self, fn, schema, tuple(source) if source is not None else None, dict(inverse or {}), batches)

    def aggregate(self, group_by: Iterable[str], begin: Callable[[Row], object], accumulate: Callable[[object, Row], object], end: Callable[[object, tuple], Mapping[str, object] | None], schema: T.StructType, source: Iterable[str] | None = None, merge: Callable[[object, object], object] | None = None) -> "Table":
        """A group to one row or none by Python functions, streamed: no group is held as a whole.

        With ``merge``, which makes one state of two, tasks aggregate their rows before the shuffle.
        """
        from .hooks import aggregate_rows, merged_rows

        if merge is not None:
            return Table(merged_rows(self, tuple(group_by), begin, accumulate, merge, end, schema, tuple(source) if source is not None else None))
        return Table(aggregate_rows(self, tuple(group_by), begin, accumulate, end, schema, tuple(source) if source is not None else None))

    def group(self, group_by: Iterable[str], order_by: str, process: Callable[[Iterator[Row]], Iterable[Mapping[str, object]]], schema: T.StructType, source: Iterable[str] | None = None) -> "Table":
        """A group's ordered rows to any rows by a Python generator, streamed."""
        from .hooks import group_rows

        return Table(group_rows(self, tuple(group_by), order_by, process, schema, tuple(source) if source is not None else None))

    def concat(self, *others: "Table") -> "Table":
        return concat(self, *others)

    def explain(self, query: str | None = None, *args: object) -> str:
        from ..plans.explain import explain

        return explain(self, query, args)


class MappedTable(Table):
    """The result of ``map``: filters on columns with an inverse run before the Python function."""

    def __init__(self, source: Table, fn: Callable, schema: T.StructType, columns: tuple[str, ...] | None, inverse: dict[str, str], batches: bool = False) -> None:
        from .hooks import map_rows

        super().__init__(map_rows(source, fn, schema, columns, batches))
        self._parts = (source, fn, schema, columns, inverse, batches)

    def derive(self, query: str, *args: object) -> Table:
        source, fn, schema, columns, inverse, batches = self._parts
        q = parse_query(query)
        terms = conjuncts(q.filter)
        below = [t for t in terms if (names := paths(t)) and names <= set(inverse)]
        if not below or q.second is not None:
            return super().derive(query, *args)

        def at_source(path: Path) -> Value:
            return source.resolve(Path((inverse[path.parts[0]], *path.parts[1:]), start=path.start, end=path.end))

        c = Compiler(at_source, args)
        narrowed = Table(filter_all(source.df, c, below), source.key, source.non_null)
        return Table(MappedTable(narrowed, fn, schema, columns, inverse, batches).df)._derive_plain(q, args)

    query = derive


def paths(node: Node) -> set[str]:
    """First names of all paths in an expression."""
    return {n.parts[0] for n in node.walk() if isinstance(n, Path)}


def plain_names(node: Node) -> set[str]:
    """Names in an expression that may be those of assigned columns."""
    return {n.parts[0] for n in node.walk() if isinstance(n, Path) and len(n.parts) == 1}


def split(terms: list[Node], assigned: set[str]) -> tuple[list[Node], list[Node]]:
    """Terms on source columns only, and those that name an assigned column."""
    after = [t for t in terms if plain_names(t) & assigned]
    return [t for t in terms if t not in after], after


def filter_all(df: DataFrame, c: Compiler, terms: list[Node]) -> DataFrame:
    for t in terms:
        v = c.value(t)
        condition = c.condition(t)
        for guard in v.guards:
            condition = condition & guard
        df = df.where(condition)
    return df


def expand(table: Table, items: tuple[Item, ...], grouping: bool = False) -> list[Item]:
    """Items with wildcards replaced by the columns not named elsewhere; excluded ones stay for their order or to group."""
    named = {i.path.name for i in items if i.path is not None and not i.wild}
    out: list[Item] = []
    wild = [i for i in items if i.wild]
    for i in items:
        if not i.wild:
            drop = i.hidden and i.expr is None and i.order is None and not grouping
            if drop and not any(w.path is None or w.path.parts == i.path.parts[: len(w.path.parts)] for w in wild) and i.path.name not in table.columns:
                raise QueryError(f"no such column: {i.path.name}", i.start, i.end)
            if not drop:
                out.append(i)
    for w in wild:
        names = table.columns if w.path is None else [f"{w.path.name}.{n}" for n in table.sub_columns(w.path)]
        out += [Item(Path(tuple(n.split(".")) if w.path is not None else (n,), start=w.start, end=w.end), start=w.start, end=w.end) for n in names if n not in named]
    return out


def concat(*tables: Table) -> Table:
    """All rows of all tables; columns meet by name in their common type, missing ones get defaults."""
    if not tables:
        raise QueryError("concat needs a table")
    fields: dict[str, T.StructField] = {}
    for t in tables:
        for f in t.df.schema.fields:
            nullable = f.name not in t.non_null
            if f.name in fields:
                old = fields[f.name]
                fields[f.name] = T.StructField(f.name, Y.common_type(old.dataType, f.dataType, True), old.nullable or nullable)
            else:
                fields[f.name] = T.StructField(f.name, f.dataType, nullable)
    schema = T.StructType(list(fields.values()))
    parts = [t.as_type(schema) for t in tables]
    return Table(reduce(lambda a, b: a.unionByName(b), (p.df for p in parts)), (), [f.name for f in schema.fields if not f.nullable])
