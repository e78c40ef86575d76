"""Views over ordered key/value pairs.

A view is a DataFrame of a unique ``key`` and a ``value``; keys of any ordered
type work, binary ones compare by unsigned bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Combiner = Callable[[Column, Column, Column], Column]


def first(key: Column, a: Column, b: Column) -> Column:
    return a


def second(key: Column, a: Column, b: Column) -> Column:
    return b


def discard(key: Column, a: Column, b: Column) -> Column:
    return F.lit(None)


class View:
    def __init__(self, df: DataFrame, reversed_: bool = False) -> None:
        self.df, self.reversed = df.select("key", "value"), reversed_

    def _with(self, df: DataFrame) -> "View":
        return View(df, self.reversed)

    # bounds

    def ge(self, key: object) -> "View":
        return self._with(self.df.where(F.col("key") >= F.lit(key)))

    def gt(self, key: object) -> "View":
        return self._with(self.df.where(F.col("key") > F.lit(key)))

    def le(self, key: object) -> "View":
        return self._with(self.df.where(F.col("key") <= F.lit(key)))

    def lt(self, key: object) -> "View":
        return self._with(self.df.where(F.col("key") < F.lit(key)))

    def prefix(self, prefix: str | bytes, trim: int = 0) -> "View":
        """Keys that start with ``prefix``, without their first ``trim`` characters."""
        rows = self.df.where(F.startswith("key", F.lit(prefix)))
        if trim:
            rows = rows.withColumn("key", F.substring("key", trim + 1, 0x7FFFFFFF))
        return self._with(rows)

    def count(self, low: object = None, high: object = None) -> int:
        """Pairs from ``low``, which is included, to ``high``, which is not."""
        rows = self.df if low is None else self.df.where(F.col("key") >= F.lit(low))
        return (rows if high is None else rows.where(F.col("key") < F.lit(high))).count()

    # shapes

    def keys(self) -> DataFrame:
        return self.df.select("key")

    def reverse(self) -> "View":
        return View(self.df, not self.reversed)

    def scan(self) -> DataFrame:
        return self.df.orderBy(F.desc("key") if self.reversed else F.asc("key"))

    def filtered(self, test: Callable[[Column, Column], Column]) -> "View":
        return self._with(self.df.where(test(F.col("key"), F.col("value"))))

    def transformed(self, value: Callable[[Column, Column], Column] | None = None, key: Callable[[Column], Column] | None = None) -> "View":
        """New values and keys; a null one drops the pair."""
        k, v = F.col("key"), F.col("value")
        rows = self.df.select((key(k) if key else k).alias("key"), (value(k, v) if value else v).alias("value"))
        return self._with(rows.where("key is not null and value is not null"))

    # sets

    def _joined(self, other: "View", how: str) -> DataFrame:
        a = self.df.select("key", F.col("value").alias("a"), F.lit(True).alias("in_a"))
        b = other.df.select("key", F.col("value").alias("b"), F.lit(True).alias("in_b"))
        return a.join(b, "key", how)

    def _combined(self, combiner: Combiner) -> Column:
        return combiner(F.col("key"), F.col("a"), F.col("b")).cast(self.df.schema["value"].dataType)

    def union(self, other: "View", combiner: Combiner = first) -> "View":
        """All keys; where both sides have one, what the combiner makes (null drops it)."""
        both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
        rows = self._joined(other, "full").select("key", F.when(both, self._combined(combiner)).otherwise(F.coalesce("a", "b")).alias("value"), both.alias("both"))
        return self._with(rows.where("not both or value is not null"))

    def intersection(self, other: "View", combiner: Combiner = first) -> "View":
        return self._with(self._joined(other, "inner").select("key", self._combined(combiner).alias("value")).where("value is not null"))

    def difference(self, other: "View", combiner: Combiner = discard) -> "View":
        """Keys of this side; where the other has it too, what the combiner makes (null drops it)."""
        both = F.col("in_b").isNotNull()
        rows = self._joined(other, "left").select("key", F.when(both, self._combined(combiner)).otherwise(F.col("a")).alias("value"), both.alias("both"))
        return self._with(rows.where("not both or value is not null"))

    # changes

    def store(self, pairs: DataFrame) -> "View":
        return self._with(self.df.join(pairs.select("key"), "key", "left_anti").unionByName(pairs.select("key", "value")))

    def insert(self, pairs: DataFrame) -> "View":
        """Pairs whose key is new are added; the others are left as they are."""
        return self._with(self.df.unionByName(pairs.select("key", "value").join(self.df.select("key"), "key", "left_anti")))

    def replace(self, pairs: DataFrame) -> "View":
        return self.store(pairs.join(self.df.select("key"), "key", "left_semi"))

    def update(self, key: object, old: object, new: object) -> "View":
        """The value of ``key`` becomes ``new`` if it is ``old``."""
        hit = (F.col("key") == F.lit(key)) & F.col("value").eqNullSafe(F.lit(old))
        return self._with(self.df.withColumn("value", F.when(hit, F.lit(new).cast(self.df.schema["value"].dataType)).otherwise(F.col("value"))))

    def delete(self, keys: DataFrame) -> "View":
        return self._with(self.df.join(keys.select("key"), "key", "left_anti"))

    def exchange(self, pairs: DataFrame) -> tuple["View", DataFrame]:
        """``store``, and the pairs that were there before."""
        return self.store(pairs), self.df.join(pairs.select("key"), "key", "left_semi")

    def remove(self, pairs: DataFrame) -> "View":
        """Pairs go whose key has just that value."""
        gone = pairs.select("key", F.col("value").alias("__gone"))
        test = (F.col("a.key") == F.col("b.key")) & F.col("a.value").eqNullSafe(F.col("b.__gone"))
        return self._with(self.df.alias("a").join(gone.alias("b"), test, "left_anti"))

    def load(self, key: object) -> object:
        row = next(iter(self.df.where(F.col("key") == F.lit(key)).select("value").take(1)), None)
        return None if row is None else row[0]

    def exists(self, key: object) -> bool:
        return bool(self.df.where(F.col("key") == F.lit(key)).select(F.lit(1)).take(1))

    # parts of binary or string values

    def read_value(self, at: int, length: int) -> "View":
        return self._with(self.df.withColumn("value", F.substring("value", at + 1, length)))

    def write_value(self, at: int, part: bytes | str) -> "View":
        t = self.df.schema["value"].dataType
        value = F.overlay(F.col("value"), F.lit(part), F.lit(at + 1))
        return self._with(self.df.withColumn("value", value.cast(t) if isinstance(t, T.StringType) else value))

    def value_length(self) -> DataFrame:
        return self.df.select("key", F.octet_length("value").alias("length"))

    def _zeros(self, length: int) -> Column:
        zeros = F.repeat(F.lit("\0"), F.lit(length))
        return F.encode(zeros, "UTF-8") if isinstance(self.df.schema["value"].dataType, T.BinaryType) else zeros

    def clear_value(self, at: int, length: int) -> "View":
        """Zero bytes from ``at`` on, but no further than the value goes."""
        here = F.least(F.lit(length), F.greatest(F.octet_length("value") - at, F.lit(0)))
        cleared = F.overlay(F.col("value"), F.substring(self._zeros(length), F.lit(1), here), F.lit(at + 1), here)
        return self._with(self.df.withColumn("value", F.when(here > 0, cleared).otherwise(F.col("value"))))

    def set_value_length(self, length: int) -> "View":
        """Values of just this many bytes: cut off, or filled up with zero bytes."""
        return self._with(self.df.withColumn("value", F.substring(F.concat(F.col("value"), self._zeros(length)), 1, length)))
