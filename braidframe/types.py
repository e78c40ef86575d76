"""Types of expressions: common types and conversions between types.

A value is a Spark column with its type and whether it may be null.  Spark has
no unsigned, unbounded or character types: unsigned values live in the next
wider type, unbounded integers in ``decimal(38,0)``, characters in strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError

BYTE, SHORT, INT, LONG = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()
FLOAT, DOUBLE, STRING, BOOLEAN = T.FloatType(), T.DoubleType(), T.StringType(), T.BooleanType()
BIG = T.DecimalType(38, 0)
NULL = T.NullType()
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    nullable: bool = True
    literal: object = None  # the value, if it is a constant
    constant: bool = False
    guards: tuple[Column, ...] = ()  # presence of the rows that the value is read through

    def with_col(self, col: Column) -> "Value":
        return replace(self, col=col, literal=None, constant=False)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, _INTEGERS)


def is_decimal(t: T.DataType) -> bool:
    return isinstance(t, T.DecimalType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def constant(value: object, kind: str | None = None) -> Value:
    """A literal or an argument."""
    if value is None:
        return Value(F.lit(None), NULL, True, None, True)
    types = {"int": INT, "long": LONG, "float": FLOAT, "double": DOUBLE, "string": STRING, "boolean": BOOLEAN}
    if kind is None:
        from decimal import Decimal

        if isinstance(value, bool):
            kind = "boolean"
        elif isinstance(value, int):
            kind = "int" if -(1 << 31) <= value < 1 << 31 else "long" if -(1 << 63) <= value < 1 << 63 else "big"
        elif isinstance(value, float):
            kind = "double"
        elif isinstance(value, Decimal):
            kind = "decimal"
        elif isinstance(value, str):
            kind = "string"
        else:
            col = F.lit(value)
            return Value(col, T._infer_type(value), False, value, True)
    if kind in ("big", "decimal"):
        from decimal import Decimal

        exact = Decimal(value)
        scale = max(0, -exact.as_tuple().exponent)
        t = T.DecimalType(38, scale)
        return Value(F.lit(exact).cast(t), t, False, value, True)
    t = types[kind]
    return Value(F.lit(value).cast(t), t, False, value, True)


def common_type(a: T.DataType, b: T.DataType, lenient: bool = False) -> T.DataType:
    """The type in which two operands meet; ``lenient`` also lets strings take in others.

    A long with a float meets in double (an exact decimal would be faithful, at
    great cost); an integer with a decimal in a decimal.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if is_number(a) and is_number(b):
        if is_integer(a) and is_integer(b):
            return a if _BOUNDS[type(a)] >= _BOUNDS[type(b)] else b
        if is_float(a) or is_float(b):
            small = (T.ByteType, T.ShortType, T.FloatType)
            return FLOAT if isinstance(a, small) and isinstance(b, small) else DOUBLE
        return T.DecimalType(38, max(x.scale if is_decimal(x) else 0 for x in (a, b)))
    if lenient and (isinstance(a, T.StringType) or isinstance(b, T.StringType)):
        return STRING
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, lenient), a.containsNull or b.containsNull)
    if isinstance(a, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(b, T.StringType):
        return a
    if isinstance(b, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(a, T.StringType):
        return b
    datetimes = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, datetimes) and isinstance(b, datetimes):
        return T.TimestampNTZType() if isinstance(a, T.TimestampNTZType) or isinstance(b, T.TimestampNTZType) else T.TimestampType()
    raise QueryError(f"no common type for {a.simpleString()} and {b.simpleString()}")


def convert(v: Value, t: T.DataType) -> Column:
    return v.col if v.type == t else v.col.cast(t)


# conversions which never fail: clamp, or take the default


def default_of(t: T.DataType) -> Column:
    """What a missing value of a type that takes no null becomes."""
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.StringType):
        return F.lit("")
    if is_number(t):
        return F.lit(0).cast(t)
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    if isinstance(t, T.BinaryType):
        return F.lit(b"")
    return F.lit(None).cast(t)


def lossy(v: Value, t: T.DataType, nullable: bool) -> Column:
    """``v`` as type ``t``: numbers clamp, what can't be read becomes the default (null if that is allowed)."""
    empty = F.lit(None).cast(t) if nullable else default_of(t)
    return F.coalesce(_lossy(v.col, v.type, t), empty) if v.type != t or (v.nullable and not nullable) else v.col


def _lossy(c: Column, a: T.DataType, b: T.DataType) -> Column:
    if a == b:
        return c
    if isinstance(a, T.NullType):
        return F.lit(None).cast(b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return F.transform(c, lambda x: F.coalesce(_lossy(x, a.elementType, b.elementType), default_of(b.elementType)))
    if isinstance(b, T.ArrayType):
        return F.when(c.isNotNull(), F.array(_lossy(c, a, b.elementType)))
    if isinstance(a, T.ArrayType):
        return _lossy(F.get(c, 0), a.elementType, b)
    if isinstance(b, T.StringType):
        return c.cast("string")
    if isinstance(b, T.BooleanType):
        if isinstance(a, T.StringType):
            low = F.lower(F.trim(c))
            return F.when(low == "true", True).when(low == "false", False).otherwise(c.try_cast("double") >= 1)
        return c > 0 if is_integer(a) or (is_decimal(a) and a.scale == 0) else c >= 1
    if isinstance(a, T.BooleanType) and is_number(b):
        return c.cast("int").cast(b)
    if is_integer(b):
        low, high = -(1 << _BOUNDS[type(b)]), (1 << _BOUNDS[type(b)]) - 1
        if is_float(a):
            clamped = F.when(F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c.cast("double"))))
            return F.when(c.isNull(), F.lit(None).cast(b)).when(c.cast("double") >= float(high), F.lit(high).cast(b)).when(c.cast("double") <= float(low), F.lit(low).cast(b)).otherwise(clamped.try_cast(b))
        exact = c.try_cast("decimal(38,10)") if isinstance(a, T.StringType) else c.cast("decimal(38,10)")
        whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
        clamped = F.greatest(F.lit(low).cast("decimal(38,0)"), F.least(F.lit(high).cast("decimal(38,0)"), whole.cast("decimal(38,0)"))).cast(b)
        return F.when(whole.isNotNull(), clamped)
    return c.try_cast(b)


def exact(v: Value, t: T.DataType) -> Column:
    """``v`` as type ``t``, or an error at run time if that loses anything."""
    if v.type == t:
        return v.col
    cast = v.col.cast(t)
    back = cast.cast(v.type)
    return F.when(v.col.isNull() | back.eqNullSafe(v.col), cast).otherwise(F.raise_error(F.concat(F.lit(f"cannot convert to {t.simpleString()} without loss: "), v.col.cast("string"))).cast(t))
