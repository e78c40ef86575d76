"""Rows on the client: which columns are set or changed, and access with conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_DOWN, Decimal, InvalidOperation

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from ..errors import QueryError, UnsetColumn

_BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


class RowBox:
    """A mutable row of a table's type; columns start unset."""

    def __init__(self, schema: T.StructType) -> None:
        self._schema, self._values, self._dirty = schema, {}, set()

    @classmethod
    def of(cls, schema: T.StructType, row: Row) -> "RowBox":
        """A clean row which holds what was read."""
        box = cls(schema)
        box._values = {n: row[n] for n in row.__fields__}
        return box

    def _known(self, name: str) -> str:
        if name not in self._schema.names:
            raise QueryError(f"no such column: {name}")
        return name

    def __getitem__(self, name: str) -> object:
        """A value; a dotted name goes through rows within, and a missing one gives None."""
        first, *rest = name.split(".")
        if self._known(first) not in self._values:
            raise UnsetColumn(first)
        value = self._values[first]
        for part in rest:
            value = None if value is None else value[part]
        return value

    def __setitem__(self, name: str, value: object) -> None:
        self._values[self._known(name)] = value
        self._dirty.add(name)

    def unset(self, name: str | None = None) -> None:
        for n in [self._known(name)] if name else list(self._values):
            self._values.pop(n, None)
            self._dirty.discard(n)

    def clean(self) -> None:
        self._dirty.clear()

    def is_set(self, name: str) -> bool:
        return self._known(name) in self._values

    def changed(self) -> set[str]:
        return set(self._dirty)

    def clone(self) -> "RowBox":
        box = RowBox(self._schema)
        box._values, box._dirty = dict(self._values), set(self._dirty)
        return box

    def copy_to(self, other: "RowBox") -> None:
        other._values, other._dirty = dict(self._values), set(self._dirty)

    def for_each(self, fn: Callable[[str, object], None]) -> None:
        for n in self._schema.names:
            if n in self._values:
                fn(n, self._values[n])

    def __iter__(self) -> Iterator[tuple[str, object]]:
        return iter([(n, self._values[n]) for n in self._schema.names if n in self._values])

    def get(self, name: str, kind: str) -> object:
        """A value as ``boolean byte short int long float double string decimal``; a loss raises."""
        value = self[name]
        if value is None:
            raise ValueError(f"{name} is null")
        if kind == "string":
            return str(value)
        if kind == "boolean":
            if value in (True, "true", 1):
                return True
            if value in (False, "false", 0):
                return False
            raise ValueError(f"{name} is no boolean")
        try:
            exact = Decimal(str(int(value) if isinstance(value, bool) else value))
        except InvalidOperation:
            raise ValueError(f"{name} is no number") from None
        if kind == "decimal":
            return exact
        if kind in ("float", "double"):
            return float(exact)
        whole = exact.to_integral_value(ROUND_DOWN)
        if whole != exact or not -(1 << _BITS[kind] - 1) <= whole < 1 << _BITS[kind] - 1:
            raise ValueError(f"{name} is no {kind}")
        return int(whole)


def changes(boxes: list[RowBox], df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows for ``State.update`` of the key and the changed columns, which must be the same ones in all boxes."""
    if not boxes:
        raise QueryError("no rows")
    names = [n for n in df.columns if n in key or n in boxes[0].changed()]
    if any(b.changed() - set(key) != boxes[0].changed() - set(key) for b in boxes):
        raise QueryError("rows change different columns")
    schema = T.StructType([df.schema[n] for n in names])
    return df.sparkSession.createDataFrame([tuple(b[n] for n in names) for b in boxes], schema)
