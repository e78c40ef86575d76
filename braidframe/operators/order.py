"""Ordering specs: ``+a``, ``-b``, ``+!c``.  Nulls are high unless ``!`` makes them low."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as Y
from ..errors import QueryError
from ..types import Value

_SPEC = re.compile(r"([+-]!?)\s*(`[^`]+`|[A-Za-z_$][\w$.]*)")


def sort_column(c: Column, flag: str) -> Column:
    return {"+": c.asc_nulls_last, "+!": c.asc_nulls_first, "-": c.desc_nulls_first, "-!": c.desc_nulls_last}[flag]()


def parse_spec(spec: str) -> list[tuple[str, str]]:
    """(name, flag) pairs of a spec such as ``+a-b``."""
    out, at = [], 0
    text = spec.strip()
    while at < len(text):
        m = _SPEC.match(text, at)
        if not m:
            raise QueryError(f"bad ordering: {spec}", at, len(text))
        out.append((m[2].strip("`"), m[1]))
        at = m.end()
        while at < len(text) and text[at] in " ,":
            at += 1
    return out


def rank_key(keys: list[tuple[Value, str]]) -> Column | None:
    """One struct whose plain order is that of ``keys``, or None if a falling key cannot be turned round."""
    parts: list[Column] = []
    for v, flag in keys:
        low = flag.endswith("!")
        falling = flag.startswith("-")
        nulls_first = low != falling
        parts.append(F.when(v.col.isNull(), F.lit(0 if nulls_first else 2)).otherwise(F.lit(1)))
        if not falling:
            parts.append(v.col)
        elif Y.is_integer(v.type):
            parts.append(-v.col.cast("decimal(20,0)"))
        elif Y.is_number(v.type):
            parts.append(-v.col)
        elif isinstance(v.type, T.BooleanType):
            parts.append(~v.col)
        else:
            return None
    return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))
