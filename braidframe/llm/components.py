"""Connected components by alternating large-star and small-star steps.

Every step is a pair of DataFrame aggregations; the links stay distributed and
each round's links are written to the shared scratch folder, which cuts the
lineage.  A node's hub is found with ``min`` (combined before the shuffle) and
joined back, so a node with very many neighbours is never gathered in a task:
adaptive execution splits such a join's large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; ``edges`` holds (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = both.join(hub, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        hub = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(hub, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        linked = linked.unionByName(hub.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return linked.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that ``links`` (two columns) names; root is the component's least node.

    Self links and null ends add nothing.  Without links the result is empty.
    """
    left, right = links.columns[:2]
    edges = links.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    edges = scratch.save(edges, "links-0")
    state = _fingerprint(edges)
    for k in range(1, most_rounds + 1):
        if state[0] == 0:
            break
        edges = scratch.save(_star(_star(edges, True), False), f"links-{k}")
        scratch.drop(f"links-{k - 1}")
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal for equal sets of links."""
    row = edges.select(F.xxhash64("a", "b").alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return (row[0], row[1])

