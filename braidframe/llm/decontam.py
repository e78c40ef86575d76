"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF; document
frequencies count all documents.  A randomised subspace iteration, whose matrix
products run in Spark over the passages, gives the leading right singular
vectors of the passage matrix.  Windows of every document are projected on them
and compared by cosine with all passages.  For each candidate the longest common
subsequence of words must cover most of the item within a stretch not much
longer than it, and the answer (or, without one, the item's rarest words) must
be there.

The basis spans benchmark passages and not the corpus: the leading directions of
a corpus are its common words, and the rare words which tell an item apart would
be lost.  It spans all passages of a block: it has as many vectors, and further
ones for passages that a float's precision loses.  Items that a text holds word
for word are also found without it, from each place of their rarest word.

Document frequencies of all items' words are counted in one pass.  Items are
taken in blocks of bounded size, which are sent to all tasks; a task goes through
the blocks one after another for each batch of texts and holds one at a time.
Many blocks share a pass over the documents, so the work grows with the items,
but the reading hardly does.  Long items are cut into pieces that are looked for
on their own, and are held by a text that has most of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, map_arrow, session_of

#: Items that are read together and bytes of their texts, on average, and passages of one block.
BLOCK_ITEMS, BLOCK_BYTES, BLOCK_PASSAGES = 1_024, 4 << 20, 384
#: Blocks that share a pass over the documents.
PASS_BLOCKS = 64
#: Items of more words are cut into pieces of at most so many.
PIECE_WORDS = 1_024
#: Words of items up to this many are sent to all tasks when documents are counted; of more, all words are counted.
MOST_WORDS = 1_000_000
#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 200_000
#: Words of a passage, of a document window, and from one window to the next.
PASSAGE, WINDOW, STRIDE = 48, 64, 32
ITERATIONS = 2
#: A passage must keep this share of its squared norm when it is projected.
LEAST_KEPT = 0.999
#: Words in more than this share of documents have no weight, but for an item's rarest ones.
COMMON, RAREST = 0.05, 8
LEAST_COSINE, LEAST_COVER = 0.3, 0.35
#: Share of an item's words in common order, stretch they may lie in (times the item's length), and share of the answer's words.
LEAST_LCS, STRETCH, LEAST_ANSWER = 0.6, 1.3, 0.5
#: Items of fewer words are only found word for word.
LEAST_WORDS = 5
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    answer: list[bytes]
    whole: tuple[int, int] = (0, 0)  # of the item of which this is a piece: words, and a hash that names it

    def part(self) -> float:
        return len(self.words) / self.whole[0] if self.whole[0] else 1.0


@dataclass
class Index:
    """What a block of items needs to be found: a bounded object that is sent to all tasks."""

    items: list[Item]
    masks: list[dict[bytes, int]]
    vocabulary: dict[bytes, int]
    weight: np.ndarray  # of each word
    basis: np.ndarray  # words x rank
    passages: np.ndarray  # passages x rank
    norms: np.ndarray  # of the passages, projected
    owner: np.ndarray  # item of each passage
    least_mass: float
    anchors: dict[int, list[tuple[int, int]]]  # by word: items of which it is the rarest, and its place there


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _words_in(rows: DataFrame) -> DataFrame:
    """(w): the distinct words of a column of texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in words_of(t)}), pa.binary())], names=["w"])

    return map_arrow(rows, "w binary", step, rows.columns[0]).distinct()


def document_frequencies(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(w, n): in how many documents each of these words occurs, over all documents; null for w counts the documents."""
    few = words.limit(MOST_WORDS + 1).count() <= MOST_WORDS
    sent = session_of(docs).sparkContext.broadcast(frozenset(bytes(r.w) for r in words.collect()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.binary()), pa.array([*seen.values(), total], pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own = set(words_of(t))
                seen.update(own if sent.value is None else sent.value & own)
                total += 1
                if len(seen) > HELD_WORDS:
                    yield told()
                    seen.clear()
                    total = 0
        yield told()

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return counts if few else counts.join(words.unionByName(words.sparkSession.createDataFrame([(None,)], "w binary")).select(F.col("w").alias("k")), F.col("w").eqNullSafe(F.col("k"))).drop("k")


def _passage_rows(items: list[Item]) -> list[tuple[int, list[bytes]]]:
    out = []
    for i, item in enumerate(items):
        if len(item.words) < LEAST_WORDS:
            continue
        parts = -(-len(item.words) // PASSAGE)
        size = -(-len(item.words) // parts)
        out += [(i, item.words[a : a + size]) for a in range(0, len(item.words), size)]
    return out


def singular_vectors(spark, rows: list[tuple[list[int], list[float]]], width: int, rank: int, iterations: int = ITERATIONS, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (width x rank) of a sparse matrix by randomised subspace iteration."""
    rank = min(rank, width, len(rows))
    table = spark.createDataFrame([(t, w) for t, w in rows], "t array<int>, w array<double>").coalesce(4)

    def product(z: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(z.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape, np.float64)
            for b in batches:
                for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    weights = np.asarray(w)
                    np.add.at(total, t, weights[:, None] * (weights @ sent.value[t]))
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

        return sum((np.frombuffer(r.part, np.float32).reshape(z.shape).astype(np.float64) for r in table.mapInArrow(run, "part binary").collect()), np.zeros(z.shape))

    z = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]
    for _ in range(iterations):
        z = np.linalg.qr(product(z))[0]
    small = z.T @ product(z)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (z @ vectors[:, np.argsort(-values)]).astype(np.float32)


def spanning(basis: np.ndarray, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    """An orthonormal basis that keeps all rows: ``basis`` and what it lacks of them."""
    lacking = []
    for t, w in rows:
        weights = np.asarray(w)
        kept = weights @ basis[t].astype(np.float64)
        if kept @ kept < LEAST_KEPT * (weights @ weights):
            rest = -(basis @ kept)
            rest[t] += weights
            lacking.append(rest / np.sqrt(weights @ weights))
    if not lacking:
        return basis
    vectors, size, _ = np.linalg.svd(np.stack(lacking, axis=1), full_matrices=False)
    return np.hstack([basis, vectors[:, size > 1e-4].astype(np.float32)])


def build_index(spark, items: list[Item], total: int, frequency: Counter[bytes]) -> Index:
    idf = {w: float(np.log(1 + total / max(1, frequency[w]))) for item in items for w in item.words}
    chosen = {w for w in idf if frequency[w] <= COMMON * total}
    for item in items:
        chosen.update(sorted(set(item.words), key=lambda w: (-idf[w], w))[:RAREST])
    vocabulary = {w: i for i, w in enumerate(sorted(chosen))}
    weight = np.array([idf[w] for w in sorted(chosen)], np.float32)
    anchors: dict[int, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        rarest = min(item.words, key=lambda w: (-idf[w], w))
        anchors.setdefault(vocabulary[rarest], []).append((i, item.words.index(rarest)))
    owner, rows = [], []
    for i, words in _passage_rows(items):
        counts = Counter(vocabulary[w] for w in words if w in vocabulary)
        if counts:
            owner.append(i)
            rows.append((list(counts), [n * float(weight[t]) for t, n in counts.items()]))
    if not rows:  # short items only
        none = np.zeros((0, 1), np.float32)
        return Index(items, [{} for _ in items], vocabulary, weight, np.zeros((len(vocabulary), 1), np.float32), none, none[:, 0], np.zeros(0, np.int64), np.inf, anchors)
    basis = spanning(singular_vectors(spark, rows, len(vocabulary), len(rows)), rows)
    passages = np.stack([np.asarray(w, np.float32) @ basis[t] for t, w in rows])
    norms = np.sqrt((passages * passages).sum(axis=1))
    mass = min(sum(x * x for x in w) for _, w in rows)
    return Index(items, [masks_of(x.words) for x in items], vocabulary, weight, basis, passages, np.maximum(norms, 1e-6), np.array(owner), LEAST_COVER * mass, anchors)


def matches(index: Index, text: str | None | list[bytes]) -> list[tuple[int, float, float]]:
    """(item, cosine, share of its words in common order) of the items that a text, or its words, hold."""
    words = text if isinstance(text, list) else words_of(text)
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    known = ids[at]
    best = near(index, words, at, known)
    for i in verbatim(index, words, at, known):
        if best.get(i, (0.0, 0.0))[1] < 1.0:
            best[i] = (1.0, 1.0)
    return [(i, c, s) for i, (c, s) in sorted(best.items())]


def verbatim(index: Index, words: list[bytes], at: np.ndarray, known: np.ndarray) -> set[int]:
    """The items whose words a text holds in one stretch, with the answer."""
    out: set[int] = set()
    for k in np.flatnonzero(np.isin(known, list(index.anchors))).tolist():
        for i, place in index.anchors[int(known[k])]:
            start, n = int(at[k]) - place, len(index.items[i].words)
            if i not in out and start >= 0 and words[start : start + n] == index.items[i].words and answered(index, i, words, start, n):
                out.add(i)
    return out


def near(index: Index, words: list[bytes], at: np.ndarray, known: np.ndarray) -> dict[int, tuple[float, float]]:
    """(cosine, share) of the items that windows of a text are near to and that it holds for the most part."""
    weight = index.weight[known]
    # window j covers the words from STRIDE * j; a word lies in the windows j and j - 1
    last = at // STRIDE
    window, entry = np.concatenate([last, last - 1]), np.concatenate([np.arange(len(at))] * 2)
    inside = window >= 0
    window, entry = window[inside], entry[inside]
    mass = np.bincount(window, weight[entry] ** 2)
    heavy = np.flatnonzero(mass >= index.least_mass)
    if not len(heavy):
        return {}
    order = np.flatnonzero(np.isin(window, heavy))
    order = order[np.argsort(window[order], kind="stable")]
    starts = np.searchsorted(window[order], heavy)
    best: dict[int, tuple[float, float]] = {}
    for a in range(0, len(heavy), 256):
        b = min(len(heavy), a + 256)
        part = order[starts[a] : starts[b] if b < len(heavy) else len(order)]
        vectors = index.basis[known[entry[part]]] * weight[entry[part]][:, None]
        vectors = np.add.reduceat(vectors, starts[a:b] - starts[a], axis=0)
        dots = vectors @ index.passages.T
        size = np.sqrt((vectors * vectors).sum(axis=1))
        cosine = dots / np.maximum(size, 1e-6)[:, None] / index.norms
        for w, p in np.argwhere((cosine >= LEAST_COSINE) & (dots >= LEAST_COVER * index.norms**2)).tolist():
            i = int(index.owner[p])
            if best.get(i, (0.0, 0.0))[1] < 1.0 and (share := verify(index, i, words, STRIDE * int(heavy[a + w]))):
                best[i] = max(best.get(i, (0.0, 0.0)), (float(cosine[w, p]), share), key=lambda x: (x[1], x[0]))
    return best


def verify(index: Index, i: int, words: list[bytes], start: int) -> float:
    """Share of the item's words that a stretch near a window has in order; 0 if too few or if the answer lacks."""
    n, masks = len(index.items[i].words), index.masks[i]
    low, high = max(0, start - n), min(len(words), start + WINDOW + n)
    length, step = int(np.ceil(STRETCH * n)), max(1, n // 8)
    best, place = 0, low
    for a in range(low, max(low + 1, high - length + step), step):
        found = lcs(masks, n, words[a : a + length])
        if found > best:
            best, place = found, a
    if best < LEAST_LCS * n:
        return 0.0
    return best / n if answered(index, i, words, place, length) else 0.0


def answered(index: Index, i: int, words: list[bytes], place: int, length: int) -> bool:
    """Whether the answer, or the item's rarest words, are near a stretch."""
    item, n = index.items[i], len(index.items[i].words)
    here = set(words[max(0, place - n // 4) : place + length + n // 4])
    if item.answer:
        wanted = item.answer
    else:
        rare = sorted(set(item.words) & index.vocabulary.keys(), key=lambda w: (-index.weight[index.vocabulary[w]], w))
        wanted = rare[: max(1, len(rare) // 3)]
    return sum(w in here for w in wanted) >= LEAST_ANSWER * len(wanted)


def _pieces(item_id: object, text: str, answer: str | None) -> list[Item]:
    words = words_of(text)
    n = -(-len(words) // PIECE_WORDS)
    size, whole = -(-len(words) // max(n, 1)), (len(words), hash(tuple(words))) if n > 1 else (0, 0)
    return [Item(item_id, words[a : a + size], words_of(answer) if n == 1 else [], whole) for a in range(0, len(words), max(size, 1))]


def indexes(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> Iterator[list[Index]]:
    """The indexes of the blocks of each pass; items without words and repeated items are left out."""
    spark = session_of(docs)
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a")).where("t is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-(size.b or 0) // BLOCK_BYTES))
    if not blocks:
        return
    counts = Scratch(spark).save(document_frequencies(docs, text, _words_in(rows.select("t"))), "frequencies")
    total = (counts.where("w is null").agg(F.sum("n")).first()[0] or 0) if size.n else 0
    if not total:
        return
    held: list[Index] = []
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        found = [_pieces(r.i, r.t, r.a) for r in part.distinct().orderBy("i", "t").collect()]
        pieces = [x for item in found for x in item]
        if not pieces:
            continue
        own = counts.join(_words_in(part.select("t")), "w", "left_semi") if blocks > 1 else counts
        frequency = Counter({bytes(r.w): r.n for r in own.where("w is not null").collect()})
        held += [build_index(spark, block, total, frequency) for block in _blocks(pieces)]
        if len(held) >= PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def _blocks(items: list[Item]) -> Iterator[list[Item]]:
    """Runs of items of so many passages together."""
    block, held = [], 0
    for item in items:
        n = -(-len(item.words) // PASSAGE)
        if block and held + n > BLOCK_PASSAGES:
            yield block
            block, held = [], 0
        block.append(item)
        held += n
    yield block


class Held:
    """The blocks of a pass, as tasks see them: of several only the one in use is in memory."""

    def __init__(self, spark, blocks: list[Index]) -> None:
        self.sent = [spark.sparkContext.broadcast(b) for b in blocks]

    def found(self, texts: list[str | None]) -> list[tuple[int, object, float, float]]:
        """(place of the text, item id, cosine, share) of the items that texts hold."""
        words = [words_of(t) for t in texts]
        best: dict[tuple[int, object], tuple[float, float]] = {}
        parts: dict[tuple[int, object, tuple[int, int]], list[tuple[float, float]]] = {}
        for s in self.sent:
            index = s.value
            for n, w in enumerate(words):
                for i, cosine, share in matches(index, w):
                    item = index.items[i]
                    if item.whole[0]:
                        parts.setdefault((n, item.item_id, item.whole), []).append((share * item.part(), cosine))
                    else:
                        best[n, item.item_id] = max(best.get((n, item.item_id), (0.0, 0.0)), (share, cosine))
            if len(self.sent) > 1 and hasattr(s, "_value"):
                del s._value  # read again from the executor's disk when its turn comes
        for (n, i, _), found in parts.items():  # pieces that make up the share which a whole item must have
            if (share := sum(x for x, _ in found)) >= LEAST_LCS:
                best[n, i] = max(best.get((n, i), (0.0, 0.0)), (share, max(c for _, c in found)))
        return [(n, i, c, s) for (n, i), (s, c) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, overlap): one row for each document row and benchmark item that it holds.

    An item found word for word, but not by its windows, has cosine 1.  Of the
    texts of a repeated item id the one of the greatest overlap counts, then of
    the greatest cosine.  A null text holds nothing; rows with a null id are
    reported with it; repeated rows are reported each.  An empty table on either
    side gives no rows.
    """
    spark = session_of(docs)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type, item_type = narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, cosine double, overlap double"
    out = spark.createDataFrame([], schema)
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    for blocks in indexes(narrow, benchmark, answer=answer):
        held = Held(spark, blocks)

        def step(batch: pa.RecordBatch, held=held) -> pa.RecordBatch | None:
            found = held.found(batch.column(1).to_pylist())
            if not found:
                return None
            row, item, cosine, share = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, item_arrow), pa.array(cosine), pa.array(share)], names=["doc_id", "item_id", "cosine", "overlap"])

        out = out.unionByName(map_arrow(narrow, schema, step, "text"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", answer: str | None = None) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns stay."""
    out, at = docs, docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for blocks in indexes(docs, benchmark, text, answer=answer):
        held = Held(session_of(docs), blocks)

        def step(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            gone = {n for n, *_ in held.found(batch.column(at).to_pylist())}
            return batch.filter(pa.array([n not in gone for n in range(batch.num_rows)], pa.bool_()))

        out = map_arrow(out, schema, step, text)
    return out
