"""Python hooks: map, aggregate and group.

Rows of a group meet through a shuffle on the group's columns and a sort within
partitions, and are then streamed past the hook, so a group of any size needs
no more memory than the hook itself keeps.  An aggregate whose states can be
merged is computed by parts before the shuffle, which then carries states and
not rows.  Hooks see rows, or whole Arrow batches where speed counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .order import parse_spec, sort_column

OUT_ROWS = 4096
#: Groups that a task holds states of before it hands them on.
HELD_STATES = 10_000


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Row]:
    make = Row(*names)
    for b in batches:
        yield from (make(*values) for values in zip(*(c.to_pylist() for c in b.columns), strict=True))


def _batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for x in found:
        held.append({n: x.get(n) for n in schema.names})
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def map_rows(table, fn: Callable, schema: T.StructType, columns: tuple[str, ...] | None, batches: bool = False) -> DataFrame:
    narrow = table.df.select(*(f"`{c}`" for c in columns)) if columns is not None else table.df
    names, out = narrow.columns, to_arrow_schema(schema)
    if batches:

        def run_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                if (made := fn(b)) is not None and made.num_rows:
                    yield made.select(out.names).cast(out)

        return narrow.mapInArrow(run_batches, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((x for r in _rows(batches, names) if (x := fn(r)) is not None), out)

    return narrow.mapInArrow(run, schema)


def _dealt(table, group_by: tuple[str, ...], order: list, columns: tuple[str, ...] | None) -> DataFrame:
    needed = None if columns is None else list(dict.fromkeys([*group_by, *(n for n, _ in order), *table.key, *columns]))
    narrow = table.df if needed is None else table.df.select(*(f"`{c}`" for c in needed))
    keys = [F.col(f"`{c}`") for c in group_by]
    dealt = narrow.repartition(*keys) if keys else narrow.coalesce(1)
    ties = [F.col(f"`{k}`") for k in table.key if k in narrow.columns]
    sorts = [*keys, *(sort_column(F.col(f"`{n}`"), flag) for n, flag in order), *ties]
    return dealt.sortWithinPartitions(*sorts) if sorts else dealt


def aggregate_rows(table, group_by, begin, accumulate, end, schema, columns) -> DataFrame:
    dealt = _dealt(table, group_by, [], columns)
    names, out = dealt.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for key, rows in groupby(_rows(batches, names), lambda r: tuple(r[c] for c in group_by)):
                state = begin(next(rows))
                for r in rows:
                    state = accumulate(state, r)
                if (x := end(state, key)) is not None:
                    yield x

        yield from _batches(found(), out)

    return dealt.mapInArrow(run, schema)


def merged_rows(table, group_by, begin, accumulate, merge, end, schema, columns) -> DataFrame:
    """``aggregate_rows`` by parts: states of the rows of a task first, then of all."""
    needed = None if columns is None else list(dict.fromkeys([*group_by, *columns]))
    narrow = table.df if needed is None else table.df.select(*(f"`{c}`" for c in needed))
    names, out = narrow.columns, to_arrow_schema(schema)
    keys = T.StructType([f for c in group_by for f in narrow.schema.fields if f.name == c])
    partial = T.StructType([*keys.fields, T.StructField("__state", T.BinaryType())])
    partial_arrow = to_arrow_schema(partial)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}

        def told() -> pa.RecordBatch:
            columns_ = [*zip(*states, strict=True)] if group_by else []
            arrays = [pa.array(c, t) for c, t in zip(columns_, partial_arrow.types, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(x) for x in states.values()], pa.binary())], schema=partial_arrow)

        for r in _rows(batches, names):
            key = tuple(r[c] for c in group_by)
            states[key] = accumulate(states[key], r) if key in states else begin(r)
            if len(states) >= HELD_STATES:
                yield told()
                states.clear()
        if states:
            yield told()

    dealt = narrow.mapInArrow(parts, partial)
    dealt = dealt.repartition(*(F.col(f"`{c}`") for c in group_by)).sortWithinPartitions(*(F.col(f"`{c}`") for c in group_by)) if group_by else dealt.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for key, rows in groupby(_rows(batches, partial.names), lambda r: tuple(r[c] for c in group_by)):
                state = pickle.loads(next(rows)["__state"])
                for r in rows:
                    state = merge(state, pickle.loads(r["__state"]))
                if (x := end(state, key)) is not None:
                    yield x

        yield from _batches(found(), out)

    return dealt.mapInArrow(run, schema)


def group_rows(table, group_by, order_by, process, schema, columns) -> DataFrame:
    dealt = _dealt(table, group_by, parse_spec(order_by), columns)
    names, out = dealt.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for _, rows in groupby(_rows(batches, names), lambda r: tuple(r[c] for c in group_by)):
                yield from process(rows)
                for _ in rows:  # what the hook left unread
                    pass

        yield from _batches(found(), out)

    return dealt.mapInArrow(run, schema)
