"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; then every vector is
given a leaf.  A query visits leaves best bin first: a priority queue holds the
branches not taken yet by their distance, the nearest is opened next.  How many
leaves are visited is calibrated: a bounded set of queries is answered exactly
against all vectors, and visits are widened until the leaves visited hold the
wanted share of the true neighbours.

Where the leaves of that tree are too large, as the sample bounds their number,
trees are fitted in Spark on a bounded sample of each leaf, level by level, until
leaves are small, so that their number grows with the rows.  Queries go down the
levels together: each keeps its best bins of a level, as many as calibration
says, and traverses their trees best bin first.

Leaves are joined with their visitors in blocks of bounded size, so a leaf which
holds a third of all vectors becomes many tasks.  Scores are cosines of the
original vectors in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, session_of

#: Bound of the sample that the tree is fitted on, and of the leaves it may get.
SAMPLE, MOST_LEAVES = 16_384, 1_024
LEAF_ROWS, BRANCHES, ROUNDS = 128, 8, 8
CALIBRATION_QUERIES, RECALL = 96, 0.97
#: Vectors with a component above this, or none above its inverse, are scaled.
FAR = 1e100
#: Vectors and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 512


@dataclass
class Node:
    centres: np.ndarray
    children: list["Node | int"] = field(default_factory=list)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        label = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (part := x[label == j]).size:
                mean = part.mean(axis=0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres, label


class Tree:
    """A hierarchical k-means tree over unit vectors; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(2, -(-len(sample) // max(leaves, 1))), rng)

    def _grow(self, x: np.ndarray, least: int, rng: np.random.Generator) -> "Node | int":
        k = min(BRANCHES, -(-len(x) // least))
        if k >= 2:
            centres, label = _kmeans(x, k, rng)
            used = np.unique((x @ centres.T).argmax(axis=1))
            if len(used) >= 2:
                label = (x @ centres[used].T).argmax(axis=1)
                node = Node(centres[used])
                node.children = [self._grow(x[label == j], least, rng) for j in range(len(used))]
                return node
        self.leaves += 1
        return self.leaves - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest centre at each level."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                label = (x[rows] @ node.centres.T).argmax(axis=1)
                todo += [(child, rows[label == j]) for j, child in enumerate(node.children)]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[tuple[int, float]]:
        """The first leaves that a best-bin-first traversal reaches from a unit vector, with the distances of their bins."""
        out: list[tuple[int, float]] = []
        queue: list[tuple[float, int, Node | int]] = [(0.0, 0, self.root)]
        pushed = 0
        while queue and len(out) < most:
            d, _, node = heapq.heappop(queue)
            while not isinstance(node, int):
                far = 1 - node.centres @ q
                best = int(far.argmin())
                for j, x in enumerate(far.tolist()):
                    if j != best:
                        pushed += 1
                        heapq.heappush(queue, (x, pushed, node.children[j]))
                node, d = node.children[best], float(far[best])
            out.append((node, d))
        return out


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part.

    Not those that are null or zero or hold a null or non-finite component, and
    not those of a null id or of another length than most have.  Vectors whose
    squares a double cannot hold are scaled by a power of two, which changes no
    cosine.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).withColumn("m", F.array_max(F.transform("v", F.abs))).where("m > 0")
    scale = F.when(F.col("m") > FAR, F.lit(2.0**-600)).when(F.col("m") < 1 / FAR, F.lit(2.0**600))
    return rows.select("id", F.when(scale.isNull(), F.col("v")).otherwise(F.transform("v", lambda x: x * scale)).alias("v"))


def block_top(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k best rows of each query within a block, never a row of the query's own id."""
    # of identical vectors only those of the k + 1 smallest ids can be among the best, one of which may be the query's own, and k rows of each
    vector = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((x_id, vector))
    first = np.concatenate([[True], vector[order][1:] != vector[order][:-1]])
    other = first | np.concatenate([[True], x_id[order][1:] != x_id[order][:-1]])
    place, ids = np.arange(len(order)), np.cumsum(other)
    run, row = ids - np.maximum.accumulate(np.where(first, ids, 0)), place - np.maximum.accumulate(np.where(other, place, 0))
    kept = order[(run <= k) & (row < k)]
    x, x_id = x[kept], x_id[kept]
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    near = (q @ x.T) / qn[:, None] / xn[None, :]
    near[q_id[:, None] == x_id[None, :]] = -np.inf
    m = min(k, near.shape[1])
    edge = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
    qi, xi = np.nonzero((near >= edge[:, None] - 1e-9) & np.isfinite(near))
    score = np.concatenate([(q[qi[a : a + 65536]] * x[xi[a : a + 65536]]).sum(axis=1) for a in range(0, len(qi), 65536)] or [np.zeros(0)]) / (qn[qi] * xn[xi])
    order = np.lexsort((x_id[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.searchsorted(qi, qi, side="left")
    best = np.arange(len(qi)) - first < k
    return q_id[qi[best]], x_id[xi[best]], score[best]


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrated(places: list[int], recall: float) -> int:
    """How many of the first leaves hold this share of the true neighbours, whose leaves are at these places."""
    return int(np.sort(places)[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) if places else 1


def _deepened(scratch: Scratch, indexed: DataFrame, asked: DataFrame, bins: DataFrame, truth: DataFrame, dim: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(id, v, leaf) and (id, leaf, far) by smaller leaves: trees below the large ones, level by level.

    ``truth`` has the calibrated queries with their true neighbours.  A leaf's
    number is that of its parent times ``MOST_LEAVES`` and its own.
    """
    h = F.xxhash64(F.lit("sample"), "id")
    low, span = -(1 << 63), float((1 << 64) - 1)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, SAMPLE)
        n = rows["n"][0].as_py()
        tree = Tree(_unit(_matrix(rows["v"].combine_chunks(), dim)), min(MOST_LEAVES, max(1, n // LEAF_ROWS)))
        return pa.table({"leaf": rows["leaf"].slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "leaves": pa.array([tree.leaves], pa.int32())})

    def place(rows: pa.Table, trees: pa.Table) -> pa.Table:
        own = np.zeros(rows.num_rows, np.int64)
        if trees.num_rows and rows.num_rows:
            own += pickle.loads(trees["tree"][0].as_py()).assign(_unit(_matrix(rows["v"].combine_chunks(), dim)))
        return pa.table({"id": rows["id"], "v": rows["v"], "leaf": pa.array(rows["leaf"].to_numpy() * MOST_LEAVES + own, pa.int64())})

    def descend(rows: pa.Table, trees: pa.Table) -> pa.Table:
        row, leaf, far = [], [], []
        tree = pickle.loads(trees["tree"][0].as_py()) if trees.num_rows and rows.num_rows else None
        units = _unit(_matrix(rows["v"].combine_chunks(), dim)) if tree else repeat(None)
        for i, at, d, unit in zip(rows["id"].to_pylist(), rows["leaf"].to_pylist(), rows["far"].to_pylist(), units, strict=False):
            for n, x in tree.visit(unit, tree.leaves) if tree else [(0, d)]:
                row.append(i)
                leaf.append(at * MOST_LEAVES + n)
                far.append(x)
        return pa.table({"id": pa.array(row, pa.int64()), "leaf": pa.array(leaf, pa.int64()), "far": pa.array(far, pa.float64())})

    level = 0
    while True:
        level += 1
        sizes = scratch.save(indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), f"sizes-{level}")
        large = sizes.where(F.col("n") > 2 * LEAF_ROWS)
        share = F.least(F.lit(1.0), F.lit(1.3 * SAMPLE) / F.col("n"))
        sample = indexed.join(large, "leaf").where((h.cast("double") - low) / span <= share).select("leaf", "n", "id", "v", h.alias("h"))
        trees = scratch.save(sample.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary, leaves int").where("leaves > 1"), f"trees-{level}")
        if not trees.limit(1).count():  # small leaves, or such as hold one vector over and over
            return indexed, bins

        def dealt(rows: DataFrame, by: DataFrame, fn, columns: str, size: int, trees: DataFrame = trees) -> DataFrame:
            """Rows meet the tree of their leaf in parts of a bounded size."""
            parts = by.select("leaf", F.ceil(F.col("n") / size).cast("int").alias("parts"))
            mine = rows.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
            theirs = trees.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            return mine.groupBy("leaf", "part").cogroup(theirs.groupBy("leaf", "part")).applyInArrow(fn, columns)

        indexed = scratch.save(dealt(indexed, sizes, place, "id long, v array<double>, leaf long", BLOCK_ROWS), f"indexed-{level}")
        asking = bins.join(asked, "id")
        down = dealt(asking, bins.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), descend, "id long, leaf long, far double", BLOCK_QUERIES)
        down = scratch.save(down.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("far", "leaf"))), f"down-{level}")
        true_leaves = truth.join(indexed.select(F.col("id").alias("vec_id"), "leaf").join(truth.select("vec_id").distinct(), "vec_id", "left_semi"), "vec_id").select("id", "leaf")
        places = [r.turn for r in down.join(true_leaves, ["id", "leaf"]).select("turn").collect()]
        bins = down.where(F.col("turn") <= _calibrated(places, 1 - (1 - recall) / 3)).drop("turn")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, ties to smaller ids.

    ``vectors`` and ``queries`` have the same columns; a query id is answered
    once (if it is repeated, for its least vector), a row of the same id never
    answers it.  Fewer candidates give fewer
    rows.  See ``usable_vectors`` for what takes no part.  Rows that repeat an
    id stay separate candidates.
    """
    spark = session_of(vectors)
    scratch = Scratch(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable_vectors(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return empty
    dim, count = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("v") == dim)
    asked = usable_vectors(queries, vec_id, embedding).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    # the tree, from the vectors of the smallest id hashes
    h = F.xxhash64(F.lit("sample"), "id")
    share = min(1.0, 1.3 * SAMPLE / count)
    limit = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    sample = np.array([r.v for r in rows.where(h <= F.lit(limit)).orderBy(h, "id").limit(SAMPLE).select("v").collect()], np.float64)
    tree = Tree(_unit(sample), min(MOST_LEAVES, max(1, count // LEAF_ROWS)))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = sent.value.assign(_unit(_matrix(b.column(1), dim)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=["id", "v", "leaf"])

    indexed = scratch.save(rows.mapInArrow(place, "id long, v array<double>, leaf long"), "indexed")
    # calibration: exact neighbours of a bounded set of queries, and the leaves that they are in
    trial = asked.orderBy(F.xxhash64(F.lit("trial"), "id"), "id").limit(CALIBRATION_QUERIES).collect()
    if not trial:
        return empty
    t_id, t_v = np.array([r.id for r in trial], np.int64), np.array([r.v for r in trial], np.float64)
    trial_sent = spark.sparkContext.broadcast((t_id, t_v))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                q, x, s = block_top(*trial_sent.value, ids, _matrix(b.column(1), dim), k)
                by = np.argsort(ids, kind="stable")
                best.append((q, x, s, leaf[by][np.searchsorted(ids[by], x)]))
                if len(best) > 8:
                    best = [_cut(best, k)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cut(best, k)], names=["query_id", "vec_id", "score", "leaf"])

    truth = _best(indexed.mapInArrow(exact, "query_id long, vec_id long, score double, leaf long"), k).collect()
    near: dict[int, list[int]] = {}
    for r in truth:
        near.setdefault(r.query_id, []).append(r.leaf)
    places = []
    for i, unit in zip(t_id.tolist(), _unit(t_v), strict=True):
        turn = {leaf: n for n, (leaf, _) in enumerate(tree.visit(unit, tree.leaves), 1)}
        places += [turn[leaf] for leaf in near.get(i, [])]
    deep = count > 2 * LEAF_ROWS * tree.leaves
    visits = _calibrated(places, 1 - (1 - recall) / 3 if deep else recall)

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, leaf, far = [], [], []
                for i, unit in zip(b.column(0).to_pylist(), _unit(_matrix(b.column(1), dim)), strict=True):
                    for n, d in sent.value.visit(unit, visits):
                        row.append(i)
                        leaf.append(n)
                        far.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(leaf, pa.int64()), pa.array(far, pa.float64())], names=["id", "leaf", "far"])

    bins = asked.mapInArrow(travel, "id long, leaf long, far double")
    if deep:
        pairs = spark.createDataFrame([(r.query_id, r.vec_id) for r in truth], "id long, vec_id long")
        indexed, bins = _deepened(scratch, indexed, asked, bins, pairs, dim, recall)
    # neighbouring leaves form bundles, and a bundle and its visitors meet in blocks, so that a query has k rows from a bundle and not from each leaf
    width = BLOCK_ROWS // LEAF_ROWS if deep else max(1, int(np.ceil(np.sqrt(tree.leaves))))
    bundle = F.floor(F.col("leaf") / width).cast("long").alias("bundle")
    visited = scratch.save(bins.groupBy("id", bundle).agg(F.collect_list("leaf").alias("leaves")), "visited")  # of a query's leaves only
    bundled = indexed.withColumn("bundle", bundle)
    held = bundled.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("rows"))
    met = visited.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("visitors"))
    blocks = held.join(met, "bundle")
    part, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    coming = visited.join(blocks, "bundle").join(asked, "id").select("bundle", part("visitors").alias("qb"), every("rows").alias("vb"), "id", "v", "leaves")
    stored = bundled.join(blocks, "bundle").select("bundle", every("visitors").alias("qb"), part("rows").alias("vb"), "id", "v", "leaf")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            q_id, q = left["id"].to_numpy(), _matrix(left["v"].combine_chunks(), dim)
            x_id, x, leaf = right["id"].to_numpy(), _matrix(right["v"].combine_chunks(), dim), right["leaf"].to_numpy()
            asking: dict[int, list[int]] = {}
            for i, leaves in enumerate(left["leaves"].to_pylist()):
                for n in leaves:
                    asking.setdefault(n, []).append(i)
            for n, who in asking.items():
                mine = np.flatnonzero(leaf == n)
                if len(mine):
                    found = block_top(q_id[who], q[who], x_id[mine], x[mine], k)
                    best.append((*found, np.full(len(found[0]), n, np.int64)))
        q, x, s, _ = _cut(best, k)
        return pa.table([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    pairs = coming.groupBy("bundle", "qb", "vb").cogroup(stored.groupBy("bundle", "qb", "vb")).applyInArrow(match, "query_id long, vec_id long, score double")
    return _best(pairs, k).select("query_id", "rank", "vec_id", "score")


def _cut(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    q, x, s, leaf = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((x, -s, q))
    q, x, s, leaf = q[order], x[order], s[order], leaf[order]
    best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[best], x[best], s[best], leaf[best]
