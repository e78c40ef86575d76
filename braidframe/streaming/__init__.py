"""Queries over streams.

The query language has no notion of event time, so only what needs one row at a
time runs on a stream: filters and plain projections.  Changed rows are applied
to a table batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..lang import parse_query
from ..operators import Table


def derive_stream(stream: DataFrame, query: str, *args: object) -> DataFrame:
    """A filter or an unordered projection over a streaming DataFrame."""
    q = parse_query(query)
    if q.second is not None or any(i.order for i in q.first or ()):
        raise QueryError("a stream can be filtered and projected only")
    return Table(stream).derive(query, *args).df


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``apply``, which may store it in a table."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
