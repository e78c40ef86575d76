"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts (orders 0 to
``ORDER``) with the counts of the bytes that follow them.  After a context a
byte that was seen there costs -log2(count / (total + distinct)); any other byte
costs the escape, -log2(distinct / (total + distinct)), and is then coded after
the next shorter context, at last among 256 equal bytes.  The statistics are
frozen once the trees are made, so the cost of a byte after a context is a
constant, and the code length of a text is an exact sum over all its bytes.

The trees of all languages share one automaton over the union of their
contexts: its state is the longest known context that ends at the current byte.
Texts of a batch are laid end to end and read by many lanes in lockstep; a lane
starts ``ORDER`` bytes early, which suffices to know its state exactly.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forgettable, map_arrow

ORDER = 4
#: Bound of the labelled sample that the trees are made from: documents and bytes of each language, and characters of one document.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LONGEST = 300, 300_000, 65_536
#: A context of two bytes or more is kept if it was seen this often.
LEAST_SEEN = 4
LANES = 2048
_LETTER = regex.compile(r"\p{L}").search
_RESET = 256


@dataclass(frozen=True)
class Model:
    """Languages in order and, for each, context -> {next byte: count}."""

    languages: tuple[str, ...]
    trees: tuple[dict[bytes, dict[int, int]], ...]


def count_contexts(texts: list[bytes], order: int = ORDER, least: int = LEAST_SEEN) -> dict[bytes, dict[int, int]]:
    """The context tree of one language; contexts end before the byte they predict and never reach over a text's start."""
    grams: Counter[bytes] = Counter()
    for t in texts:
        for k in range(1, order + 2):
            grams.update(t[i : i + k] for i in range(len(t) - k + 1))
    tree: dict[bytes, dict[int, int]] = defaultdict(dict)
    for g, n in grams.items():
        tree[g[:-1]][g[-1]] = n
    kept = {c: follow for c, follow in tree.items() if len(c) < 2 or sum(follow.values()) >= least}
    return {c: f for c, f in kept.items() if all(c[i:] in kept for i in range(1, len(c)))}


def train(rows: list[tuple[str, str]], order: int = ORDER) -> Model:
    """A model from (language, text) pairs."""
    by: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in rows:
        by[lang].append(text.encode("utf-8", "surrogatepass"))
    languages = tuple(sorted(by))
    return Model(languages, tuple(count_contexts(by[x], order) for x in languages))


class Scorer:
    """The automaton of a model with the cost of every byte in every state."""

    def __init__(self, model: Model) -> None:
        seen = {b for tree in model.trees for follow in tree.values() for b in follow}
        self.classes = np.full(257, len(seen), np.int64)  # bytes never seen share a class
        for k, b in enumerate(sorted(seen)):
            self.classes[b] = k
        self.width = len(seen) + 2
        self.classes[_RESET] = self.width - 1
        # every prefix of a context must be a state, so that it can be reached byte by byte
        states = {c[:i] for tree in model.trees for c in tree for i in range(len(c) + 1)} | {b""}
        order = sorted(states, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(order)}
        self.costs = []
        for tree in model.trees:
            cost = np.full((len(order), self.width), 8.0)
            for c in order:
                i = number[c]
                if c:
                    cost[i] = cost[number[self._shorter(c, number)]]
                if follow := tree.get(c):
                    total, kinds = sum(follow.values()), len(follow)
                    cost[i] -= np.log2(kinds / (total + kinds))
                    cost[i, self.classes[list(follow)]] = -np.log2(np.array(list(follow.values())) / (total + kinds))
            cost[:, -1] = 0
            self.costs.append(cost.astype(np.float32).ravel())
        step = np.zeros((len(order), self.width), np.int32)
        for c in order:
            i = number[c]
            if c:
                step[i] = step[number[self._shorter(c, number)]]
            for b in seen:
                if (k := number.get(c + bytes([b]))) is not None:
                    step[i, self.classes[b]] = k
        step[:, -2:] = 0
        self.step = (step * self.width).ravel()  # a state is the place of its first cost
        self.order = max(map(len, order))

    @staticmethod
    def _shorter(c: bytes, number: dict[bytes, int]) -> bytes:
        while True:
            c = c[1:]
            if c in number:
                return c

    def places(self, classes: np.ndarray) -> np.ndarray:
        """For each symbol the place of its cost in the state reached before it."""
        n, warm = len(classes), self.order
        lanes = min(LANES, max(1, n // 64))
        length = -(-n // lanes)
        padded = np.full(warm + lanes * length, self.width - 1, classes.dtype)
        padded[warm : warm + n] = classes
        columns = np.lib.stride_tricks.as_strided(padded, (lanes, warm + length), (length * padded.itemsize, padded.itemsize))
        columns = np.ascontiguousarray(columns.T)
        out = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(warm + length):
            at = state + columns[t]
            if t >= warm:
                out[t - warm] = at
            state = self.step[at]
        return np.ascontiguousarray(out.T).ravel()[:n]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        if not texts:
            return np.zeros((0, len(self.costs)))
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        classes = self.classes[raw].astype(np.int32)
        classes[starts + sizes - 1] = self.width - 1
        at = self.places(classes)
        return np.stack([np.add.reduceat(cost[at], starts, dtype=np.float64) for cost in self.costs], axis=1)


_SCORERS: dict[str, Scorer] = {}
forgettable(_SCORERS.clear)


def scorer_for(key: str, model: Model) -> Scorer:
    """The scorer of a model, made once in a worker; ``key`` names the model."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def training_rows(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows for each language: those of the smallest hashes of ``key``, ties by text.

    Of a text of more than ``SAMPLE_LONGEST`` characters its first ones are
    learned from, so a language of long texts only is learned too.  Rows without
    a language or text, and empty texts, teach nothing; no such row at all gives
    an empty sample.
    """
    h = F.xxhash64(F.lit("sample"), F.col(key).cast("string"))
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), h.alias("h")).where("lang is not null and text is not null and text <> ''")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return []
    shares = {r.lang: min(1.0, 2.0 * most / r.n) for r in sizes}
    limits = [(x, int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1) for x, share in shares.items()]
    few = docs.sparkSession.createDataFrame(limits, "lang string, most bigint")  # a row for each language
    usable = labelled.join(F.broadcast(few), "lang").where("h <= most").withColumn("text", F.substring("text", 1, SAMPLE_LONGEST))
    order = Window.partitionBy("lang").orderBy("h", "text")
    ranked = usable.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_bytes)
    return [(r.lang, r.text) for r in sorted(held.select("lang", "r", "text").collect(), key=lambda r: (r.lang, r.r))]


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The columns ``keep``, then (as ``names`` say) lang_pred, score (the winner's posterior) and bits_per_byte (the winner's).

    The language of the shortest code wins, ties go to the first name.  A null
    text, one without a letter, or any text under a model of no language gets
    ``und`` with score 0 and null bits.  Rows stay one to one, repeated ones too;
    whole texts count.  An empty table gives no rows.
    """
    narrow = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "`{}` string, `{}` double, `{}` double".format(*names)])
    out_names, shared = [*keep, *names], docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keep)).to_pylist()
        usable = [i for i, t in enumerate(texts) if t and shared.value.languages and _LETTER(t)]
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in usable]
        bits = scorer_for(key, shared.value).code_lengths(raw) if usable else np.zeros((0, 1))
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
        lang, prob, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        for j, i in enumerate(usable):
            lang[i], prob[i], rate[i] = shared.value.languages[best[j]], float(score[j]), float(least[j] / len(raw[j]))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(prob, pa.float64()), pa.array(rate, pa.float64())], names=out_names)

    return map_arrow(narrow, schema, step, "__text", max_bytes=1 << 20, max_rows=4096)
