"""A catalogue of tables in a folder of Parquet data sets, or in the session's own catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import Table, View, join, join_identity
from ..operators.join import JoinTable


class Database:
    """Tables by name; ``root`` may be on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self._keys: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}

    def declare(self, name: str, key: Iterable[str] = (), non_null: Iterable[str] = ()) -> "Database":
        """What Parquet doesn't say: the primary key and the columns that hold no null."""
        self._keys[name] = (tuple(key), tuple(non_null))
        return self

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def find_table(self, name: str) -> Table | None:
        if self.root is not None:
            if not self._exists(self._path(name)):
                return None
            df = self.spark.read.parquet(self._path(name))
        else:
            if not self.spark.catalog.tableExists(name):
                return None
            df = self.spark.table(name)
        return Table(df, *self._keys.get(name, ((), ())))

    def open_table(self, name: str, schema: T.StructType | None = None) -> Table:
        """A table by name; with a schema its columns are converted to it, and an absent table is empty."""
        table = self.find_table(name)
        key, non_null = self._keys.get(name, ((), ()))
        if table is None:
            if schema is None:
                raise KeyError(f"no such table: {name}")
            return Table(self.spark.createDataFrame([], schema), key, non_null)
        return table.as_type(schema, key) if schema is not None else table

    def as_view(self, df: DataFrame) -> View:
        return View(df)

    def temporary(self, name: str, table: Table) -> None:
        table.df.createOrReplaceTempView(name)

    def names(self) -> list[str]:
        if self.root is None:
            return sorted(t.name for t in self.spark.catalog.listTables())
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))

    def save(self, name: str, table: Table) -> None:
        """Write a new table; an existing one is an error."""
        table.df.write.parquet(self._path(name))

    def rename(self, old: str, new: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self._path(old)).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.rename(p(self._path(old)), p(self._path(new))):
            raise KeyError(f"cannot rename {old}")
        self._keys[new] = self._keys.pop(old, ((), ()))

    def delete(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True):
            raise KeyError(f"no such table: {name}")

    def backup(self, target: str) -> None:
        """Copy all tables to another folder."""
        for name in self.names():
            self.find_table(name).df.write.parquet(f"{target.rstrip('/')}/{name}.parquet")

    def restore(self, source: str) -> None:
        """Write the tables of a backup to this folder; an existing one is an error."""
        backup = Database(self.spark, source)
        present = [n for n in backup.names() if self.root is not None and self._exists(self._path(n))]
        if present:
            raise KeyError(f"the table exists: {present[0]}")
        for name in backup.names():
            backup.find_table(name).df.write.parquet(self._path(name))

    def analyze(self, name: str) -> DataFrame:
        return self.open_table(name).df.summary("count", "min", "max")

    def join(self, spec: str) -> JoinTable:
        """Join tables of this database by their names."""
        from ..operators.join import parse_spec

        return join(spec, **{n: self.open_table(n) for n in parse_spec(spec).names()})

    def identity(self) -> Table:
        return join_identity(self.spark)
