"""The function library: three scalar functions and seven aggregates, which are window functions too."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as Y
from ..errors import QueryError
from ..types import Value

#: Aggregates; all of them but first and last skip nulls and need no order.
AGGREGATES = ("count", "first", "last", "min", "max", "sum", "avg")
NUMERIC = ("min", "max", "sum", "avg")


def _coalesce(c, call) -> Value:
    if not call.args:
        raise QueryError("coalesce needs an argument", call.start, call.end)
    values = [c.value(a) for a in call.args]
    common = reduce(lambda t, v: Y.common_type(t, v.type, True), values[1:], values[0].type)
    return Value(F.coalesce(*(Y.convert(v, common) for v in values)), common, all(v.nullable for v in values))


def _iif(c, call) -> Value:
    if len(call.args) != 3:
        raise QueryError("iif needs three arguments", call.start, call.end)
    test, a, b = c.condition(call.args[0]), c.value(call.args[1]), c.value(call.args[2])
    common = Y.common_type(a.type, b.type, True)
    return Value(F.when(test, Y.convert(a, common)).otherwise(Y.convert(b, common)), common, a.nullable or b.nullable)


def _random(c, call) -> Value:
    """random(): a double from 0 to 1; random(max) and random(min, max): of the arguments' type, max excluded."""
    if len(call.args) > 2:
        raise QueryError("random takes two arguments at most", call.start, call.end)
    if not call.args:
        return Value(F.rand(), Y.DOUBLE, False)
    values = [c.value(a) for a in call.args]
    common = reduce(lambda t, v: Y.common_type(t, v.type), values[1:], values[0].type)
    if not Y.is_number(common):
        raise QueryError("random needs numbers", call.start, call.end)
    low = F.lit(0.0) if len(values) == 1 else values[0].col.cast("double")
    x = low + F.rand() * (values[-1].col.cast("double") - low)
    return Value((F.floor(x) if not Y.is_float(common) else x).cast(common), common, any(v.nullable for v in values))


SCALAR: dict[str, Callable[..., Value]] = {"coalesce": _coalesce, "iif": _iif, "random": _random}


def check_argument(name: str, v: Value | None, call) -> None:
    if v is None:
        if name != "count":
            raise QueryError(f"{name} needs an argument", call.start, call.end)
    elif name in NUMERIC and not Y.is_number(v.type):
        raise QueryError(f"{name} needs a number", call.start, call.end)


def sum_type(t: T.DataType) -> T.DataType:
    if Y.is_float(t):
        return Y.DOUBLE
    if Y.is_decimal(t):
        return T.DecimalType(38, t.scale)
    return Y.BIG if isinstance(t, T.LongType) else Y.LONG


def result_type(name: str, v: Value | None) -> T.DataType:
    if name == "count":
        return Y.LONG
    if name == "sum":
        return sum_type(v.type)
    if name == "avg":
        return T.DecimalType(38, min(38, max(v.type.scale, 10))) if Y.is_decimal(v.type) else Y.DOUBLE
    return v.type


def aggregate_column(name: str, v: Value | None) -> Column:
    """The unordered aggregates; the same column works over a window."""
    if name == "count":
        return F.count(F.lit(1)) if v is None or not v.nullable else F.count(v.col)
    if name == "sum":
        t = sum_type(v.type)
        return F.sum(v.col.cast(t))
    if name == "avg":
        return F.avg(v.col) if Y.is_decimal(v.type) else F.avg(v.col.cast("double"))
    return {"min": F.min, "max": F.max}[name](v.col)


def finish(name: str, v: Value | None, c: Column) -> Column:
    """A sum of nothing is zero; types are made exact."""
    t = result_type(name, v)
    return F.coalesce(c.cast(t), F.lit(0).cast(t)) if name == "sum" else c.cast(t)
