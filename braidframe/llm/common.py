"""Shared helpers: reading tables, scratch tables, Arrow building blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch from Spark at most.
ROWS_PER_BATCH = 1000
#: Rows of one Arrow batch that an operator looks at together at most.
ROWS_PER_STEP = 256
#: Text bytes that an operator lays out together at most (one longer text is
#: always processed whole, on its own).
BYTES_PER_STEP = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder which the cluster names; one of our own only in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='braidframe-')}"


#: Folders of scratch tables that this process has made.
_MADE: list[str] = []


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/braidframe-{uuid.uuid4().hex}"
        _MADE.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete the scratch tables that operators of this process have made; results that were not read yet need them."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(batch: pa.RecordBatch, column: str, max_bytes: int = BYTES_PER_STEP, max_rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``max_bytes`` together; no row is cut."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def bound_batches(spark: SparkSession) -> None:
    """Spark hands over batches of so many rows, whatever their size: lower the session's number where it is above ours."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


#: What operators keep in a Python worker from one batch to the next, by what throws it away.
_FORGET: list[Callable[[], None]] = []
_OWNER: list[str] = [""]


def forgettable(clear: Callable[[], None]) -> None:
    """Name a function that throws away what an operator keeps in a worker."""
    _FORGET.append(clear)


def enter(owner: str) -> None:
    """Workers serve one operator after another: throw away what the last one kept."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for clear in _FORGET:
            clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library need not have it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str | None = None, max_bytes: int = BYTES_PER_STEP, max_rows: int = ROWS_PER_STEP) -> DataFrame:
    """``mapInArrow`` which hands ``step`` batches of bounded text size."""
    bound_batches(df.sparkSession)

    owner = f"{step.__module__}.{step.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        for batch in batches:
            parts = small_batches(batch, text, max_bytes, max_rows) if text else [batch]
            for part in parts:
                if part.num_rows and (out := step(part)) is not None:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def text_column(df: DataFrame, name: str) -> DataFrame:
    """Column ``name`` as string, so that any other type of text-like column is accepted."""
    return df.withColumn(name, F.col(name).cast("string"))
