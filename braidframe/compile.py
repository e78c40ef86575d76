"""Syntax trees to Spark columns, with comparisons that are never unknown.

Null equals null and is higher than anything else.  The forms emitted stay plain
where a side cannot be null and keep an outermost comparison with the column
otherwise, so that Parquet scans still take them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as Y
from .errors import QueryError
from .lang.nodes import Binary, Call, Literal, Node, Param, Path, RangeOf, Unary, negated
from .types import Value

Resolver = Callable[[Path], Value]
_SWAPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


class Compiler:
    """Compiles expressions; ``resolve`` finds columns, ``call`` compiles functions that are not scalar ones."""

    def __init__(self, resolve: Resolver, args: tuple[object, ...] = (), call: Callable[[Call], Value] | None = None, variables: Mapping[str, Value] | None = None) -> None:
        self.resolve, self.args, self.call = resolve, args, call
        self.variables = variables if variables is not None else {}

    def value(self, node: Node) -> Value:
        if isinstance(node, Literal):
            return Y.constant(node.value, node.kind)
        if isinstance(node, Param):
            return Y.constant(self.argument(node))
        if isinstance(node, Path):
            if len(node.parts) == 1 and node.parts[0] in self.variables:
                return self.variables[node.parts[0]]
            return self.resolve(node)
        if isinstance(node, Unary):
            return self.unary(node)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Call):
            from .functions import SCALAR

            if node.name in SCALAR and not node.named:
                return SCALAR[node.name](self, node)
            if self.call is None:
                raise QueryError(f"unknown function, or one that needs a group: {node.name}", node.start, node.end)
            return self.call(node)
        if isinstance(node, RangeOf):
            raise QueryError("a range stands in a window frame only", node.start, node.end)
        raise QueryError(f"cannot compile {type(node).__name__}", node.start, node.end)

    def argument(self, node: Param) -> object:
        if node.number > len(self.args):
            raise QueryError(f"no argument for ?{node.number}", node.start, node.end)
        return self.args[node.number - 1]

    def condition(self, node: Node) -> Column:
        """A filter: true or false for every row."""
        v = self.value(node)
        if not isinstance(v.type, (T.BooleanType, T.NullType)):
            raise QueryError("a filter must be boolean", node.start, node.end)
        return F.coalesce(v.col.cast("boolean"), F.lit(False)) if v.nullable else v.col

    def unary(self, node: Unary) -> Value:
        if node.op == "!":
            inner = negated(node.operand)
            if not (isinstance(inner, Unary) and inner.op == "!"):
                return self.value(inner)
            v = self.value(node.operand)
            if not isinstance(v.type, T.BooleanType):
                raise QueryError("! needs a boolean", node.start, node.end)
            return v.with_col(~v.col)
        v = self.value(node.operand)
        if not Y.is_number(v.type):
            raise QueryError(f"unary {node.op} needs a number", node.start, node.end)
        return v.with_col(-v.col) if node.op == "-" else v

    def binary(self, node: Binary) -> Value:
        if node.op in ("&&", "||"):
            left, right = self.condition(node.left), self.condition(node.right)
            return Value(left & right if node.op == "&&" else left | right, Y.BOOLEAN, False)
        if node.op == "in":
            return self.within(node)
        left, right = self.value(node.left), self.value(node.right)
        guards = (*left.guards, *right.guards)
        try:
            if node.op in ("==", "!=", "<", "<=", ">", ">="):
                if node.left == node.right and node.op in ("==", "!=", "<=", ">="):
                    return Value(F.lit(node.op != "!="), Y.BOOLEAN, False, guards=guards)
                return Value(compare(node.op, left, right), Y.BOOLEAN, False, guards=guards)
            out = arithmetic(node.op, left, right)
        except QueryError as e:
            raise QueryError(str(e), node.start, node.end) from None
        return Value(out.col, out.type, out.nullable, guards=guards)

    def within(self, node: Binary) -> Value:
        v = self.value(node.left)
        listed = self.argument(node.right) if isinstance(node.right, Param) else None
        if isinstance(node.right, Param):
            values = [] if listed is None else list(listed)
            plain = [x for x in values if x is not None]
            tests = []
            if plain:
                types = reduce(Y.common_type, (Y.constant(x).type for x in plain))
                if isinstance(v.type, T.StringType) != isinstance(types, T.StringType):
                    found = v.col.cast("string").isin([str(x) for x in plain])
                else:
                    found = v.col.isin(plain)
                tests.append(found & v.col.isNotNull() if v.nullable else found)
            if len(plain) < len(values) and v.nullable:
                tests.append(v.col.isNull())
            return Value(reduce(lambda a, b: a | b, tests) if tests else F.lit(False), Y.BOOLEAN, False, guards=v.guards)
        array = self.value(node.right)
        if not isinstance(array.type, T.ArrayType):
            raise QueryError("in needs an array", node.start, node.end)
        return Value(F.coalesce(F.exists(array.col, lambda x: x.eqNullSafe(v.col)), F.lit(False)), Y.BOOLEAN, False, guards=(*v.guards, *array.guards))


def compare(op: str, a: Value, b: Value) -> Column:
    if isinstance(a.type, T.StringType) != isinstance(b.type, T.StringType) and not isinstance(a.type, T.NullType) and not isinstance(b.type, T.NullType) and (Y.is_number(a.type) or Y.is_number(b.type)):
        if op not in ("==", "!="):
            raise QueryError("a string and a number have no order")
        common = Y.STRING
    else:
        common = Y.common_type(a.type, b.type)
    x, y = Y.convert(a, common), Y.convert(b, common)
    if a.constant and b.constant and a.literal is None and b.literal is None:
        return F.lit(op in ("==", "<=", ">="))
    if op in ("==", "!="):
        if b.constant and b.literal is None:
            same = x.isNull() if a.nullable else F.lit(False)
        elif a.constant and a.literal is None:
            same = y.isNull() if b.nullable else F.lit(False)
        else:
            same = x.eqNullSafe(y) if a.nullable or b.nullable else x == y
        return same if op == "==" else ~same
    if op in ("<", "<="):
        a, b, x, y, op = b, a, y, x, _SWAPPED[op]
    plain = x > y if op == ">" else x >= y
    if not a.nullable and not b.nullable:
        return plain
    if op == ">=":
        if not b.nullable:
            return plain | x.isNull()
        return plain & y.isNotNull() if not a.nullable else F.coalesce(plain, F.lit(False)) | x.isNull()
    if not b.nullable:
        return plain | x.isNull()
    return plain & y.isNotNull() if not a.nullable else F.coalesce(plain, F.lit(False)) | (x.isNull() & y.isNotNull())


def arithmetic(op: str, a: Value, b: Value) -> Value:
    nullable = a.nullable or b.nullable
    if op in ("&", "|", "^"):
        if isinstance(a.type, T.BooleanType) and isinstance(b.type, T.BooleanType):
            return Value({"&": a.col & b.col, "|": a.col | b.col, "^": a.col != b.col}[op], Y.BOOLEAN, nullable)
        common = Y.common_type(a.type, b.type)
        if not Y.is_integer(common):
            raise QueryError(f"{op} needs integers or booleans")
        x, y = Y.convert(a, common), Y.convert(b, common)
        if op == "&" and (_is(a, 0) or _is(b, 0)):
            return Value(F.lit(0).cast(common), common, False)
        return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op].cast(common), common, nullable)
    common = Y.common_type(a.type, b.type)
    if isinstance(common, T.NullType):
        return Value(F.lit(None), Y.NULL)
    if not Y.is_number(common):
        raise QueryError(f"{op} needs numbers")
    x, y = Y.convert(a, common), Y.convert(b, common)
    zero = F.lit(0).cast(common)
    if not Y.is_float(common) and ((op == "*" and (_is(a, 0) or _is(b, 0))) or (op == "%" and _is(b, 1))):
        return Value(zero, common, False)
    if op == "+":
        out = x + y
    elif op == "-":
        out = x - y
    elif op == "*":
        out = x * y
    elif Y.is_float(common):
        nan = F.lit(float("nan")).cast(common)
        if op == "/":
            edge = F.when((x == 0) | F.isnan(x), nan).when(x > 0, F.lit(float("inf")).cast(common)).otherwise(F.lit(float("-inf")).cast(common))
            out = F.when(y == 0, F.when(x.isNotNull(), edge)).otherwise(x / y)
        else:
            out = F.when(y == 0, F.when(x.isNotNull(), nan)).otherwise(x % y)
    elif op == "/":
        out = F.call_function("div", x, y) if Y.is_integer(common) else F.bround(x / y, common.scale)
    else:
        out = x % y
    return Value(out.cast(common), common, nullable)


def _is(v: Value, n: int) -> bool:
    return v.constant and v.literal == n and not isinstance(v.literal, bool) and v.literal is not None
