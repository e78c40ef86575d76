"""Changes to a table as pure functions: a state and rows give a new state.

Spark's tables are immutable, so each verb is built of joins on the primary key;
nothing runs before an action, but for the checks that may have to raise.  Keys
are judged by the state that a verb leads to, so rows may swap their values.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as Y
from ..errors import KeyConflict, QueryError
from .table import Table

Key = tuple[str, ...]


def _columns(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _on(df: DataFrame, other: DataFrame, how: str, key: Key) -> DataFrame:
    """A join on equal keys, in which null equals null; ``df`` is a, ``other`` is b."""
    test = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in key]
    return df.alias("a").join(other.alias("b"), reduce(lambda x, y: x & y, test), how)


class State:
    """A table with a primary key and unique alternate keys that verbs may change.

    With a ``view``, a filter, verbs see only the rows that it takes, and rows
    that they would leave outside of it are an error.
    """

    def __init__(self, table: Table, alternate_keys: Iterable[Iterable[str]] = (), view: str | None = None, view_args: tuple[object, ...] = ()) -> None:
        if not table.key:
            raise QueryError("changes need a primary key")
        self.table, self.alternate = table, tuple(tuple(k) for k in alternate_keys)
        self.view, self.view_args = view, view_args

    def _next(self, df: DataFrame) -> "State":
        return State(Table(df, self.table.key, self.table.non_null), self.alternate, self.view, self.view_args)

    @property
    def df(self) -> DataFrame:
        return self.table.df

    @property
    def seen(self) -> DataFrame:
        """The rows within the view."""
        return self.df if self.view is None else self.df.where(self.table.predicate(self.view, *self.view_args))

    # checks

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns; they must lie within the view."""
        for f in self.table.row_type.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType) if f.name not in self.table.non_null else Y.default_of(f.dataType))
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.table.row_type.fields))
        self._check_view(rows)
        return rows

    def _check_view(self, rows: DataFrame) -> None:
        if self.view is not None and rows.where(~Table(rows, (), self.table.non_null).predicate(self.view, *self.view_args)).take(1):
            raise QueryError("a row lies outside the view")

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of several rows with one primary key the last by all columns counts."""
        whole = F.struct(*_columns(rows.columns))
        return rows.groupBy(*_columns(self.table.key)).agg(F.max(whole).alias("__row")).select("__row.*")

    def _checked(self, df: DataFrame, changed: DataFrame) -> "State":
        """The state of these rows, in which no alternate key that ``changed`` has may occur twice."""
        for key in self.alternate:
            touched = _on(df, changed.select(*_columns(key)), "left_semi", key)
            if touched.groupBy(*_columns(key)).count().where("count > 1").take(1):
                raise KeyConflict(f"the alternate key {key} exists")
        return self._next(df)

    # verbs

    def store(self, rows: DataFrame) -> "State":
        """Insert or replace."""
        new = self._last(self._shaped(rows))
        if self.view is not None and _on(new, self.df, "left_semi", self.table.key).count() != _on(new, self.seen, "left_semi", self.table.key).count():
            raise QueryError("a row outside the view has the primary key")
        return self._checked(_on(self.df, new, "left_anti", self.table.key).unionByName(new), new)

    def exchange(self, rows: DataFrame) -> tuple["State", DataFrame]:
        """``store``, and the rows that were there before."""
        return self.store(rows), _on(self.df, rows, "left_semi", self.table.key)

    def insert(self, rows: DataFrame) -> "State":
        """Add rows; a primary or alternate key that exists, or that two of them have, is an error."""
        new = self._shaped(rows)
        if _on(new, self.df, "left_semi", self.table.key).take(1) or new.groupBy(*_columns(self.table.key)).count().where("count > 1").take(1):
            raise KeyConflict("the primary key exists")
        return self._checked(self.df.unionByName(new), new)

    def try_insert(self, rows: DataFrame) -> "State":
        """Rows are added in order of the primary key, then of all columns; those of which a key exists by then are left out."""
        new, keys = self._shaped(rows), (self.table.key, *self.alternate)
        for key in keys:
            new = _on(new, self.df, "left_anti", key)
        if not self.alternate:
            whole = F.struct(*_columns(new.columns))
            return self._next(self.df.unionByName(new.groupBy(*_columns(self.table.key)).agg(F.min(whole).alias("__row")).select("__row.*")))
        kept = self.df
        place = F.struct(*_columns(self.table.key), *_columns(c for c in new.columns if c not in self.table.key))
        while new.take(1):
            # a row that comes first under all of its keys goes in; each round settles some, and mostly all
            first = new.distinct().withColumn("__at", place)
            for key in keys:
                least = first.groupBy(*_columns(key)).agg(F.min("__at").alias("__least"))
                first = _on(first, least, "inner", key).where("a.__at = b.__least").select("a.*")
            first = first.drop("__at")
            kept = kept.unionByName(first)
            for key in keys:
                new = _on(new, first, "left_anti", key)
        return self._next(kept)

    def replace(self, rows: DataFrame) -> "State":
        if _on(rows, self.seen, "left_anti", self.table.key).take(1):
            raise KeyError("no such row")
        return self.try_replace(rows)

    def try_replace(self, rows: DataFrame) -> "State":
        """Rows whose primary key is not there are left out."""
        return self.store(_on(self._shaped(rows), self.seen, "left_semi", self.table.key))

    def _updated(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All rows with the other columns of ``rows`` put in, and those that it names."""
        changed = [c for c in rows.columns if c not in self.table.key]
        unknown = [c for c in rows.columns if c not in self.df.columns]
        if unknown:
            raise QueryError(f"no such column: {unknown[0]}")
        mine = _on(rows, self.seen, "left_semi", self.table.key) if self.view is not None else rows
        new = mine.groupBy(*_columns(self.table.key)).agg((F.max(F.struct(*_columns(changed))) if changed else F.lit(None)).alias("__row")).withColumn("__hit", F.lit(True))
        joined = _on(self.df, new, "left", self.table.key)
        hit = F.col("b.__hit").isNotNull()

        def column(f: T.StructField) -> Column:
            old = F.col(f"a.`{f.name}`")
            return (F.when(hit, F.col(f"b.__row.`{f.name}`").cast(f.dataType)).otherwise(old) if f.name in changed else old).alias(f.name)

        made = joined.select(*(column(f) for f in self.table.row_type.fields), hit.alias("__hit"))
        return made.drop("__hit"), made.where("__hit").drop("__hit")

    def update(self, rows: DataFrame) -> "State":
        """Only the columns of ``rows`` change; every key must exist."""
        if _on(rows, self.seen, "left_anti", self.table.key).take(1):
            raise KeyError("no such row")
        return self.try_update(rows)

    def try_update(self, rows: DataFrame) -> "State":
        df, touched = self._updated(rows)
        self._check_view(touched)
        return self._checked(df, touched)

    def merge(self, rows: DataFrame) -> tuple["State", DataFrame]:
        """``update``, and the rows as they are afterwards."""
        out = self.update(rows)
        return out, _on(out.df, rows, "left_semi", self.table.key)

    def try_merge(self, rows: DataFrame) -> tuple["State", DataFrame]:
        """``try_update``, and the rows as they are afterwards."""
        out = self.try_update(rows)
        return out, _on(out.seen, rows, "left_semi", self.table.key)

    def delete(self, keys: DataFrame) -> "State":
        gone = _on(self.seen, keys, "left_semi", self.table.key) if self.view is not None else keys
        return self._next(_on(self.df, gone, "left_anti", self.table.key))

    def _hit(self, query: str, args: tuple[object, ...]) -> Column:
        hit = self.table.predicate(query, *args) if query else F.lit(True)
        return hit & self.table.predicate(self.view, *self.view_args) if self.view is not None else hit

    def delete_all(self, query: str = "", *args: object) -> tuple["State", int]:
        """Rows that a filter takes go; also how many."""
        hit = self._hit(query, args)
        return self._next(self.df.where(~hit)), self.df.where(hit).count()

    def update_all(self, query: str, *args: object, **changes: Column) -> "State":
        """Rows that a filter takes get new values; keys stay."""
        if set(changes) & set(self.table.key):
            raise QueryError("keys cannot be updated")
        rows = self.df.withColumn("__hit", self._hit(query, args))
        types = {f.name: f.dataType for f in self.table.row_type.fields}
        made = rows.select(*((F.when(F.col("__hit"), changes[c].cast(types[c])).otherwise(F.col(f"`{c}`")) if c in changes else F.col(f"`{c}`")).alias(c) for c in self.df.columns), "__hit")
        touched = made.where("__hit").drop("__hit")
        self._check_view(touched)
        df = made.drop("__hit")
        return self._checked(df, touched) if any(set(k) & set(changes) for k in self.alternate) else self._next(df)


Check = str | Callable[[DataFrame], Column] | None


class MappedState:
    """Changes through a mapped table: target rows are mapped back and go to the source's state.

    ``inverse`` gives each source column as the name of the target column that it
    equals, or as a function of the target's columns.  A verb is refused unless
    there is a check for it: a filter, or a function of the source rows that
    gives a condition, which every row must meet.
    """

    def __init__(self, source: State, forward: Callable[[DataFrame], DataFrame], inverse: Mapping[str, str | Callable[[DataFrame], Column]], store: Check = None, update: Check = None, delete: Check = None) -> None:
        self.source, self.forward, self.inverse = source, forward, dict(inverse)
        self.checks = {"store": store, "update": update, "delete": delete}
        lost = set(source.table.key) - set(self.inverse)
        if lost:
            raise QueryError(f"no inverse for the key column {sorted(lost)[0]}")

    @property
    def df(self) -> DataFrame:
        """The mapped rows."""
        return self.forward(self.source.seen)

    def _back(self, rows: DataFrame, verb: str, whole: bool) -> DataFrame:
        out = {}
        for name, of in self.inverse.items():
            if callable(of):
                try:
                    out[name] = of(rows)
                    rows.select(out[name])
                except Exception:
                    if whole or name in self.source.table.key:
                        raise
                    del out[name]  # made of columns that these rows do not have
            elif of in rows.columns:
                out[name] = F.col(f"`{of}`")
            elif whole or name in self.source.table.key:
                raise QueryError(f"no such column: {of}")
        types = {f.name: f.dataType for f in self.source.table.row_type.fields}
        back = rows.select(*(c.cast(types[n]).alias(n) for n, c in out.items()))
        check = self.checks[verb]
        if check is None:
            raise QueryError(f"the mapped table takes no {verb}")
        test = check(back) if callable(check) else Table(back, (), self.source.table.non_null & set(back.columns)).predicate(check) if check else F.lit(True)
        if back.where(~F.coalesce(test, F.lit(False))).take(1):
            raise QueryError(f"a row fails the check of the mapped table's {verb}")
        return back

    def _with(self, source: State) -> "MappedState":
        return MappedState(source, self.forward, self.inverse, **self.checks)

    def store(self, rows: DataFrame) -> "MappedState":
        return self._with(self.source.store(self._back(rows, "store", True)))

    def insert(self, rows: DataFrame) -> "MappedState":
        return self._with(self.source.insert(self._back(rows, "store", True)))

    def replace(self, rows: DataFrame) -> "MappedState":
        return self._with(self.source.replace(self._back(rows, "store", True)))

    def update(self, rows: DataFrame) -> "MappedState":
        return self._with(self.source.update(self._back(rows, "update", False)))

    def delete(self, keys: DataFrame) -> "MappedState":
        back = self._back(keys, "delete", False)
        return self._with(self.source.delete(back.select(*_columns(self.source.table.key))))


def _parts(scan: DataFrame, name: str, state: State) -> DataFrame:
    """The rows of one table in a scan: those of its struct column, or of the scan itself."""
    rows = scan.where(F.col(f"`{name}`").isNotNull()).select(f"`{name}`.*") if name in scan.columns else scan
    return rows.select(*_columns(c for c in rows.columns if c in state.df.columns))


def update_scanned(scan: DataFrame, **states: State) -> dict[str, State]:
    """What an updater over a scan of several tables does: changed rows go back to their tables.

    In a scan of a join each table's rows are a struct of its name, as
    ``Table.rows`` gives them.  Rows of a concatenation have the tables' columns
    and go to the tables that hold their keys.
    """
    return {name: state.try_update(_parts(scan, name, state)) for name, state in states.items()}


def delete_scanned(scan: DataFrame, **states: State) -> dict[str, State]:
    """The rows of a scan of several tables leave those of them that are named."""
    return {name: state.delete(_parts(scan, name, state).select(*_columns(state.table.key))) for name, state in states.items()}


#: A window over numbers holds so many of them at most, as a power of two.
_BITS = 14


def _running(df: DataFrame, bound: int) -> DataFrame:
    """``__sum``: the sum of ``__w`` over all rows whose ``__x``, from 0 and below ``bound``, is not higher.

    Numbers are cut into stretches, whose totals are summed up in the same way.
    """
    if bound <= 1 << _BITS:
        return df.withColumn("__sum", F.sum("__w").over(Window.partitionBy(F.lit(0)).orderBy("__x")))
    part = F.shiftright("__x", _BITS)
    totals = _running(df.groupBy(part.alias("__x")).agg(F.sum("__w").alias("__w")), ((bound - 1) >> _BITS) + 1)
    totals = totals.select(F.col("__x").alias("__p"), (F.col("__sum") - F.col("__w")).alias("__before"))
    # broadcasting the rows, whose size may be guessed too low, would leave all of them to the one task of the totals
    df = df.withColumn("__part", part).join(totals.hint("merge"), F.col("__part") == F.col("__p"))
    return df.withColumn("__sum", F.col("__before") + F.sum("__w").over(Window.partitionBy("__part").orderBy("__x"))).drop("__part", "__p", "__before")


def automatic_key(df: DataFrame, name: str, low: int = 1, high: int = (1 << 63) - 1, seed: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """Give each row its own key from ``low`` to ``high``, never zero, and none that ``table`` has.

    Rows are numbered through and the numbers are scattered over all keys one to
    one, so no two rows draw the same.  Beside a table, row number i gets the
    i-th number whose key the table does not have: with t the number of the
    table's j-th key in order of numbers, from 0, that is i and one for each key
    with t - j <= i.  More rows than keys are an error beside a table; without
    one keys come round again, which ``insert`` refuses.
    """
    zero = low <= 0 <= high
    span = high - low + 1 - zero
    draw = random.Random(seed)
    step = next(x for x in iter(lambda: draw.randrange(1, span + 1), None) if math.gcd(x, span) == 1) if span > 0 else 1
    shift = draw.randrange(span) if span > 0 else 0
    wide = "decimal(38,0)"

    def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = rows.withColumn("__n", F.monotonically_increasing_id())
        sizes = {r.p: r.n for r in rows.groupBy(F.shiftright("__n", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each partition
        starts, total = [], 0
        for p in sorted(sizes):
            starts += [F.lit(p), F.lit(total)]
            total += sizes[p]
        at = F.create_map(*starts)[F.shiftright("__n", 33)] if starts else F.lit(0)
        return rows.withColumn("__n", at.cast("long") + F.col("__n").bitwiseAND((1 << 33) - 1)), total

    whole = lambda x: F.lit(str(x)).cast(wide)

    def keyed(rows: DataFrame) -> DataFrame:
        key = (F.col("__n").cast(wide) * whole(step) + whole(shift)) % whole(span) + whole(low)
        return rows.withColumn(name, (F.when(key >= 0, key + 1).otherwise(key) if zero else key).cast("long")).select(*_columns(columns))

    def numbers(keys: DataFrame) -> DataFrame:
        """What ``keyed`` makes these keys of, as ``__x``; those that it does not make are left out."""
        back = pow(step, -1, span)
        keys = keys.select(F.col(f"`{name}`").cast(wide).alias("k")).where((F.col("k") >= whole(low)) & (F.col("k") <= whole(high)))
        if zero:
            keys = keys.where("k <> 0").withColumn("k", F.when(F.col("k") > 0, F.col("k") - 1).otherwise(F.col("k")))
        keys = keys.select(((F.col("k") - whole(low) - whole(shift) + whole(span)) % whole(span)).cast(wide).alias("k"))
        # in two halves, as the product of two 64-bit numbers has more than 38 digits
        high_half = (F.expr("k div 4294967296").cast(wide) * whole(back)) % whole(span)
        return keys.select(((high_half * whole(1 << 32) + F.col("k") % whole(1 << 32) * whole(back)) % whole(span)).cast(wide).alias("__x")).distinct()

    columns = df.columns if name in df.columns else [*df.columns, name]
    left, n = numbered(df.drop(name))
    if table is None:
        return keyed(left)
    taken = table.count()
    if n + taken > span:
        taken = numbers(table).count() if span > 0 else 0
        if n + taken > span:
            raise KeyConflict("too few keys")
    if not n:
        return keyed(left)
    bound = n + taken  # no row gets a number beyond
    met = numbers(table).where(F.col("__x") < whole(bound)).select(F.col("__x").cast("long").alias("__x"), F.lit(1).cast("long").alias("__w"))
    ahead = _running(met, bound).groupBy((F.col("__x") - F.col("__sum") + 1).alias("__x")).agg(F.sum("__w").alias("__w")).where(F.col("__x") < n)
    rows = left.withColumn("__x", F.col("__n")).withColumn("__w", F.lit(0).cast("long"))
    made = _running(rows.unionByName(ahead, allowMissingColumns=True), n).where("__n is not null")
    return keyed(made.withColumn("__n", F.col("__n") + F.col("__sum")))


def sorter(batches: Iterable[DataFrame], key: Iterable[str], reverse: bool = False) -> DataFrame:
    """All batches in order of a key; of rows with one key that of the last batch stays."""
    names = list(key)
    numbered = [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(lambda a, b: a.unionByName(b), numbered)
    whole = F.struct("__batch", *(f"`{c}`" for c in rows.columns if c != "__batch"))
    kept = rows.groupBy(*(f"`{k}`" for k in names)).agg(F.max(whole).alias("__row")).select("__row.*").drop("__batch")
    return kept.orderBy(*(F.desc(k) if reverse else F.asc(k) for k in names))
