"""Near-duplicate detection with SimHash and Golay-code fuzzy keys.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most two.
The fingerprint is cut into three segments (22, 21 and 21 bits), each padded to
a 23-bit word of the perfect binary Golay code.  The words within distance two
of each other always share a codeword at distance four or less from both (the
codeword next to the word half way between them), and a word has either one or
six such codewords.  Two wrong bits leave one of three segments without error,
so a pair of linked fingerprints meets under one of the keys

    (i, segment i exactly, index of a codeword near segment i + 1)

of 35 bits, of which a fingerprint has 16 on average.  Candidates that share a
key are joined and verified by counting differing bits.

Buckets with more than ``bucket_limit`` fingerprints take an exact other way
without pairs: words that differ from a fingerprint in at most one bit (65 of
them) become keys, two fingerprints share such a word exactly if they differ in
at most two bits, and one word has 65 fingerprints around it at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, session_of
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are counted together.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - shingle_words + 1))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        part = hashes[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts = np.bincount(part[:, byte], minlength=256)
            ones[8 * byte : 8 * byte + 8] += counts @ _BYTE_BITS
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned SimHash of one text; 0 for a null or empty one."""
    return simhash(shingle_hashes(text, shingle_words))


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial: 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """By syndrome: the errors of weight four or less (one or six; unused places are -1)."""
    out = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for mask, s in zip(masks.tolist(), _syndrome(masks).tolist(), strict=True):
            out[s, filled[s]] = mask
            filled[s] += 1
    return out


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) of every key of every fingerprint."""
    fingerprints = fingerprints.astype(np.uint64)
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owners, keys = [], []
    for i in range(3):
        word = parts[(i + 1) % 3]
        errors = error_patterns()[_syndrome(word)]
        row, place = np.nonzero(errors >= 0)
        index = (word[row] ^ errors[row, place]) >> 11  # systematic part of the codeword
        owners.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | index)
    return np.concatenate(owners), np.concatenate(keys)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle_words: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """The columns ``keep`` and ``name`` (the fingerprint as a signed long)."""
    narrow = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), f"`{name}` bigint"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, shingle_words) for t in batch.column(len(keep)).to_pylist()]
        fps = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*keep, name])

    return map_arrow(narrow, schema, step, "__text")


def fingerprint_links(fps: DataFrame, scratch: Scratch, bucket_limit: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in one or two bits.

    Every such pair is linked, or connected by a path of such links if it lies
    in a bucket of more than ``bucket_limit`` fingerprints.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy()
        owner, key = fuzzy_keys(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], names=["key", "fp"])

    keys = map_arrow(fps.select("fp"), "key bigint, fp bigint", step)
    keys = scratch.save(keys, "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.save(keys.join(sizes, "key"), "shared")
    small = shared.where(F.col("n") <= bucket_limit)
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where("a > b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    around = crowded.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp")
    balls = around.groupBy("word").agg(F.collect_list("fp").alias("near")).where("size(near) > 1")  # 65 at most
    stars = balls.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_limit: int = 64, shingle_words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, *keep): one row per row of ``docs``.

    ``component_id`` is the smallest id that a row's links reach, its own
    included; ``root`` names the component by a fingerprint.  A null or empty
    text has fingerprint zero, which is linked as any other.  A null id takes
    part in linking and is never a component id unless no row of the component
    has an id.  Repeated rows stay repeated.  An empty table gives no rows.
    """
    scratch = Scratch(session_of(docs))
    marked = scratch.save(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep), keep=("doc_id", *keep), shingle_words=shingle_words), "fingerprints")
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(fps, scratch, bucket_limit), scratch)
    scratch.drop("keys")
    scratch.drop("shared")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("fp", "root").join(least, "root")
    return marked.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *keep)


def keep_representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_limit: int = 64, find: Callable[..., DataFrame] = near_duplicates, mark: Callable[..., DataFrame] = with_fingerprint) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest id.

    Columns stay as they are.  Rows are told apart by id and fingerprint, so an
    id that is repeated with other texts keeps only the row that is wanted; of
    rows that agree in both (or in the fingerprint if every id of a component is
    null) the one of the least JSON form stays.  ``find`` and ``mark`` give the
    components and the fingerprints.
    """
    scratch = Scratch(session_of(docs))
    found = scratch.save(find(docs, text, doc_id, bucket_limit).select("doc_id", "fingerprint", "component_id", "root"), "found")
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("doc_id").alias("__id"), F.min("fingerprint").alias("__fp"))
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__many"))
    chosen = scratch.save(least.join(repeated, F.col("__id").eqNullSafe(F.col("__many")), "left").withColumn("plain", F.col("__id").isNotNull() & F.col("__many").isNull()).drop("__many"), "chosen")
    kept = docs.join(chosen.where("plain").select("__id"), docs[doc_id] == F.col("__id"), "left_semi")
    again = chosen.where("not plain")
    if again.limit(1).count():
        marked = mark(docs, text, keep=tuple(docs.columns), name="__fp64").withColumn("__mark", F.lower(F.lpad(F.hex("__fp64"), 16, "0")))
        left = marked.join(again.select("__id", "__fp", F.col("root").alias("__root")), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__fp")))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = left.select("__root", row.alias("__row")).groupBy("__root").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
        kept = kept.unionByName(one.select("__row.*"))
    return kept
