"""SimHash near-duplicate detection of five-word shingles, completed so that no pair is missed.

Two texts are linked if the sets of their shingles' 64-bit hashes have a Jaccard
similarity of 4/5 or more.  The Golay keys of their SimHash fingerprints bring
together texts that differ little; at 4/5, however, fingerprints of 64 bits
differ in about ten bits, which no Golay key bridges.  So sets meet under a
second kind of key too.  Linked sets of a and b shingles differ in (a + b) / 9
shingles at most, so of (a + b) / 9 + 1 parts into which hashes are dealt, one
part holds the same shingles in both: its content is the key (Arasu, Ganti and
Kaushik's PartEnum, first level).  Sizes fall into classes which grow by 5/4; a
set has the keys of its own class and of the next one, as a linked set lies
there at most.  An empty part is a key only for sets that have no more filled
parts than may differ, which are those that need it.  There are some parts more
than that, so linked sets share several keys: as many as a set has filled parts
beyond those that may differ.  Sets that merely have a passage in common share
fewer, mostly one.

Each distinct set is given its keys once.  Keys go through the shuffle in packed
runs, and a task remembers the first set of each key only, so that a key which
very many sets have is streamed and never held.  Each set is compared with the
one that it has most keys in common with, and with others that it has enough of;
then, under keys whose sets these links have not joined, with one set of the
largest component; and then those of different components are compared: all pairs under keys
of few sets; under crowded ones, sets that differ from a common hub in the same rare
shingles (``apart_pairs``), and all pairs only where that costs less.  Pairs are sifted by
size and by the parities of counts, 512 of them where sets meet and as many as
shingles for the pairs that are left.  Sifts only rule out what cannot be linked;
verified are the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, map_arrow, session_of
from .components import connected_components

SHINGLE_WORDS = 5
#: Keys of one bucket, on average, and those a task looks at together.
BUCKET_KEYS, CHUNK_KEYS = 1 << 20, 1 << 18
#: Sets of a crowded key are compared pair by pair where one of them has so few crowded keys, as they meet no oftener, and
#: the key so few sets, as comparing each with all costs less there than its differences from a hub; others by ``apart_pairs``.
LIGHT_KEYS, PAIRED_SETS = 16, 1024
#: Counts whose parities are kept beside each key.
BITS = 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE_WORDS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray) -> int:
    """Names a set; 0 for the empty one."""
    return int(_mix(hashes + _GOLD).sum(dtype=np.uint64))


@lru_cache(maxsize=1)
def size_classes() -> np.ndarray:
    """The least size of each class: a set of at most 5/4 the size lies in the same class or the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, np.int64)


def _parts(hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, shingles that may differ, mixed hashes, their parts) in a set's class and the next one."""
    bounds, mixed = size_classes(), _mix(hashes)
    own = int(np.searchsorted(bounds, len(hashes), "right")) - 1
    for level in (own, own + 1):
        differ = 2 * (int(bounds[level + 1]) - 1) // 9
        yield level, differ, mixed, (mixed >> np.uint64(20)) % np.uint64(differ + 1 + differ // 8)


def part_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set; linked sets share one."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    out = []
    for level, differ, mixed, part in _parts(hashes):
        order = np.argsort(part, kind="stable")
        filled, start = np.unique(part[order], return_index=True)
        content = np.add.reduceat(_mix(mixed[order] + _GOLD), start)
        if len(filled) <= differ:
            rest = np.setdiff1d(np.arange(differ + 1 + differ // 8, dtype=np.uint64), filled)
            filled, content = np.concatenate([filled, rest]), np.concatenate([content, np.zeros(len(rest), np.uint64)])
        out.append(_mix(_mix(content + _GOLD) ^ _mix(filled * np.uint64(1009) + np.uint64(level + 1))))
    return np.concatenate(out)


def least_shared(hashes: np.ndarray) -> int:
    """So many keys a set shares with any that it is linked to; one less than it has to be, as two keys may look alike."""
    if not len(hashes):
        return 1
    return max(1, min(int(np.count_nonzero(np.bincount(part.astype(np.int64)))) - differ - 1 for _, differ, _, part in _parts(hashes)))


def parities(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """So many bits, a power of two: whether an odd number of shingles falls on each; sets differ in as many shingles as bits at least."""
    return np.packbits((np.bincount((_mix(hashes) >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def wide_parities(hashes: np.ndarray) -> bytes:
    """Parities of at least as many counts as shingles."""
    return parities(hashes, max(BITS, 1 << max(0, len(hashes) - 1).bit_length())).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer counts."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _with(docs: DataFrame, text: str, keep: tuple[str, ...], columns: str, of) -> DataFrame:
    """The columns ``keep`` and those that ``of`` makes of the shingle hashes of each text."""
    narrow = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), columns])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        added = of([simhash.shingle_hashes(t, SHINGLE_WORDS) for t in batch.column(len(keep)).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *added.values()], names=[*keep, *added])

    return map_arrow(narrow, schema, step, "__text")


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_signature(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns ``keep`` and ``name`` (the signature as a signed long)."""
    return _with(docs, text, keep, f"`{name}` bigint", lambda all_: {name: _longs([signature(np.unique(h)) for h in all_])})


_P = tuple(f"p{i}" for i in range(BITS // 64))


def _marks(hashes: list[np.ndarray]) -> dict[str, pa.Array]:
    sets = [np.unique(h) for h in hashes]
    bits = np.stack([parities(s).view(np.int64) for s in sets])
    return {
        "fp": _longs([signature(s) for s in sets]), "sim": _longs([simhash.simhash(h) for h in hashes]), "size": pa.array([len(s) for s in sets], pa.int64()),
        "need": pa.array([least_shared(s) for s in sets], pa.int64()), "wide": pa.array([wide_parities(s) for s in sets], pa.binary()), **{p: pa.array(bits[:, i]) for i, p in enumerate(_P)},
    }


def packed_keys(sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, the sets' signatures): the keys of all sets in runs, one for each bucket; 40 bits of a key tell it from others of its bucket."""
    found = [part_keys(s) for s in sets]
    keys = np.concatenate(found)
    owner = np.repeat(np.array([signature(s) for s in sets], np.uint64), [len(x) for x in found])
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    keys = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for part in np.split(order, starts[1:]) if len(order) else ():
        yield int(bucket[part[0]]), keys[part].tobytes(), owner[part].tobytes()


class SharedKeys:
    """Streams (key, set) of one bucket and gives back (key, set, first set) of the keys that several sets have.

    Held are the distinct keys with their first sets; a key's other sets pass through.
    """

    def __init__(self) -> None:
        self.keys, self.first, self.told = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def add(self, keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, sets = keys[order], sets[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        own, first = keys[starts], sets[starts].copy()
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        first[known] = self.first[at[known]]
        shared = known | (counts > 1)
        late = at[known][~self.told[at[known]]]  # their first set was not given back, as it stood alone
        self.told[late] = True
        inside = np.repeat(shared, counts)
        out = (np.concatenate([self.keys[late], keys[inside]]), np.concatenate([self.first[late], sets[inside]]), np.concatenate([self.first[late], np.repeat(first, counts)[inside]]))
        new = ~known
        merged = np.concatenate([self.keys, own[new]])
        by = np.argsort(merged, kind="stable")
        self.keys, self.first, self.told = merged[by], np.concatenate([self.first, first[new]])[by], np.concatenate([self.told, shared[new]])[by]
        return out


def shared_keys(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, fp, first): the keys that several sets have, with each of them and with the one seen first."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = list(packed_keys([shingle_set(t) for t in batch.column(0).to_pylist()], buckets))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs, strict=True) if runs else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "owners"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, held, n = SharedKeys(), None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                raw, owners = (b"".join(c) for c in zip(*held, strict=True))
                held.clear()
                keys = np.zeros((len(owners) // 8, 8), np.uint8)
                keys[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
                out = seen.add(keys.view("<u8").ravel() | np.uint64(at << 40), np.frombuffer(owners, np.uint64))
                for a in range(0, len(out[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)].view(np.int64)) for c in out], names=["key", "fp", "first"])

        for b in batches:
            for bucket, keys, owners in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    yield from flush()
                    seen, at, n = SharedKeys(), bucket, 0
                held.append((keys, owners))
                n += len(owners) // 8
                if n >= CHUNK_KEYS:
                    yield from flush()
                    n = 0
        yield from flush()

    runs = map_arrow(texts, "bucket int, keys binary, owners binary", pack, "text", max_rows=1024)
    return runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, "key bigint, fp bigint, first bigint")


def _near(x: str, y: str) -> str:
    """A condition that linked sets meet: sizes, and parities that differ in as many counts as shingles may at most."""
    odd = " + ".join(f"bit_count({x}.{p} ^ {y}.{p})" for p in _P)
    return f"5 * least({x}.size, {y}.size) >= 4 * greatest({x}.size, {y}.size) and 9 * ({odd}) <= {x}.size + {y}.size"


def _sifted(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, which sizes and wide parities do not rule out."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(fps.select(F.col("fp").alias(side), F.col("size").alias(f"n{side}"), F.col("wide").alias(f"w{side}")), side)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for na, nb, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "wa", "wb")), strict=True):
            m = min(len(wa), len(wb))
            x, y = (fold(np.frombuffer(w, np.uint8), m) for w in (wa, wb))
            keep.append(9 * int(np.bitwise_count(x ^ y).sum()) <= na + nb)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b", "na", "nb", "wa", "wb")
    return map_arrow(pairs, "a bigint, b bigint", step)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts' shingle sets have a similarity of 4/5 or more."""
    x, y = (texts.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, held = [], {}
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
            held = {k: held[k] if k in held else shingle_set(t) for k, t in ((a, ta), (b, tb))}
            same = len(np.intersect1d(held[a], held[b], assume_unique=True))
            keep.append(9 * same >= 4 * (len(held[a]) + len(held[b])))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb"), "a bigint, b bigint", step, "ta")


def hub_differences(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(most, fp, d, hub_size, odd): the ``d`` shingles that are in a set or in its hub ``most``, but not in both."""
    x, y = (texts.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}")) for c in ("fp", "most"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        odd, sizes, hub, held = [], [], None, None
        for most, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("most", "tfp", "tmost")), strict=True):
            if held is None or most != hub:
                hub, held = most, shingle_set(ty)
            odd.append(np.setxor1d(shingle_set(tx), held, assume_unique=True).view(np.int64))
            sizes.append(len(held))
        columns = [pa.array([len(o) for o in odd], pa.int64()), pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("most"), batch.column("fp"), *columns], names=["most", "fp", "d", "hub_size", "odd"])

    return map_arrow(crowd.select("most", "fp").join(x, "fp").join(y, "most").select("most", "fp", "tfp", "tmost"), "most bigint, fp bigint, d bigint, hub_size bigint, odd array<bigint>", step, "tfp")


def ranked_differences(crowd: DataFrame, differ: DataFrame) -> DataFrame:
    """Each set's differences from its hub by rank ``r``, 1 for the one that most sets of the hub have; those that no other set has are left out, and those of too low a rank.

    Linked sets x and y have (dx + dy - (nx + ny) / 9) / 2 differences in common at
    least; so many are 1 or more if either is ``far``, that is not linked to the hub
    itself.  The rarest of them has at least that rank in both.  For a set alone, the
    least that this can be over all partners follows from the triangle inequality.
    """
    each = differ.select("most", "fp", "d", "hub_size", F.explode("odd").alias("el"))
    often = each.groupBy("most", "el").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("most", "fp").orderBy(F.desc("n"), F.desc("el")))
    ranked = each.join(often, ["most", "el"]).withColumn("r", rank).drop("n").join(crowd, ["most", "fp"]).withColumn("far", F.expr("9 * d > size + hub_size"))
    return ranked.where("if(far, 10 * r >= 9 * d - size - hub_size, 18 * r >= 9 * d + hub_size - size)")


def apart_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b), a < b, also repeatedly: the pairs of one hub's sets from different components that may be linked, unless both are linked to the hub."""
    meet = "x.most = y.most and x.el = y.el and x.fp < y.fp and x.root <> y.root and (x.far or y.far)"
    enough = "18 * least(x.r, y.r) >= 9 * (x.d + y.d) - x.size - y.size"
    return ranked.alias("x").join(ranked.alias("y"), F.expr(f"{meet} and {enough} and {_near('x', 'y')}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_limit: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id, root): as ``simhash.near_duplicates``, by shingle sets; ``fingerprint`` is the set's signature.

    Texts without words have the same, empty set and are linked to each other only.
    """
    scratch = Scratch(session_of(docs))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    columns = ", ".join(f"{p} bigint" for p in _P)
    every = scratch.save(_with(narrow, "text", ("doc_id",), f"fp bigint, sim bigint, size bigint, need bigint, wide binary, {columns}", _marks), "every")
    marked = scratch.save(every.select("doc_id", "fp"), "marked")
    fps = scratch.save(every.groupBy("fp", "size", "need", "wide", *_P).agg(F.min("doc_id").alias("least"), F.min("sim").alias("sim")), "fps")
    scratch.drop("every")

    def texts_of(asked: DataFrame) -> DataFrame:
        """(fp, text) of the rows whose ids are the least ones of the wanted sets; a repeated id brings other texts too."""
        wanted = asked.select(F.col("least").alias("id"), "fp")
        return narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("fp", "text")

    def texts_for(pairs: DataFrame, name: str) -> DataFrame:
        """(fp, text), one row for each set that the pairs' two columns name."""
        asked = pairs.toDF("a", "b")
        asked = asked.select(F.col("a").alias("fp")).unionByName(asked.select(F.col("b").alias("fp"))).distinct()
        texts = _with(texts_of(fps.join(asked, "fp", "left_semi")), "text", ("fp", "text"), "own bigint", lambda all_: {"own": _longs([signature(np.unique(h)) for h in all_])})
        return scratch.save(texts.where("own = fp").select("fp", "text").dropDuplicates(["fp"]), f"{name}-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(_sifted(pairs, fps), f"{name}-pairs")
        texts = texts_for(pairs, name)
        found = scratch.save(_verified(pairs, texts), name)
        scratch.drop(f"{name}-texts")
        return found

    # fingerprints: each set with the least one of its fingerprint, and the least ones of linked fingerprints
    hubs = scratch.save(fps.groupBy("sim").agg(F.min("fp").alias("hub")), "hubs")
    own = fps.join(hubs, "sim").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    links = scratch.save(simhash.fingerprint_links(hubs.select(F.col("sim").alias("fp")), scratch, bucket_limit), "linked")
    across = links.join(hubs.select(F.col("sim").alias("a"), F.col("hub").alias("ha")), "a").join(hubs.select(F.col("sim").alias("b"), F.col("hub").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    # parts: each set with the one that it shares most keys with
    total = fps.agg(F.sum("size")).first()[0] or 0
    shared = scratch.save(shared_keys(texts_of(fps).select("text"), max(32, -(-total // (2 * BUCKET_KEYS)))), "shared")
    common = shared.where("fp <> first").groupBy("fp", "first").agg(F.count(F.lit(1)).alias("n"))
    best = common.groupBy("fp").agg(F.max_by("first", F.struct("n", "first")).alias("best"))
    close = common.join(best, "fp").join(fps.select("fp", "need"), "fp").where("first = best or n >= need")
    pairs = own.unionByName(across).unionByName(close.select(F.col("fp").alias("a"), F.col("first").alias("b")))
    links = verified(pairs, "links")
    roots = scratch.save(connected_components(links, scratch), "roots-0")

    def apart(roots: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The sets of each key with their components, and the keys of several with the component that most are in and its least set."""
        known = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "size", "need", *_P, F.coalesce("root", "fp").alias("root"))
        held = shared.select("key", "fp").join(known.select("fp", "root"), "fp").groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.min("fp").alias("hub"))
        held = held.groupBy("key").agg(F.max_by(F.struct("root", "hub"), F.struct("rows", "root")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("n"))
        held = scratch.save(held.where("parts > 1").select("key", F.col("most.root").alias("most"), F.col("most.hub").alias("hub"), "n"), name)
        return shared.select("key", "fp").join(known, "fp").join(held, "key"), held

    # under a key whose sets these links have not joined, all of other components are compared with one set of the largest
    placed, held = apart(roots, "held-0")
    hubs = held.select("key", F.col("hub").alias("fp")).join(fps.select("fp", "size", *_P), "fp")
    star = placed.where("root <> most").alias("x").join(hubs.alias("y"), F.expr(f"x.key = y.key and {_near('x', 'y')}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    links = scratch.save(links.unionByName(verified(star, "star")), "joined")
    roots = scratch.save(connected_components(links, scratch), "roots-1")
    # what is still apart: pairs of different components under a key of few sets, or with one that has few crowded keys
    placed, _ = apart(roots, "held-1")
    few, crowded = placed.where(F.col("n") <= bucket_limit), scratch.save(placed.where(F.col("n") > bucket_limit), "crowded")
    rest = few.alias("x").join(few.alias("y"), F.expr(f"x.key = y.key and x.fp < y.fp and x.root <> y.root and x.most = y.most and {_near('x', 'y')}"))
    crowded = crowded.join(crowded.groupBy("fp").agg(F.count(F.lit(1)).alias("keys")), "fp").withColumn("light", F.expr(f"keys <= {LIGHT_KEYS} and n <= {PAIRED_SETS}"))
    light, paired = crowded.where("light"), crowded.where(F.col("n") <= PAIRED_SETS)
    more = light.alias("x").join(paired.alias("y"), F.expr(f"x.key = y.key and x.root <> y.root and (x.fp < y.fp or not y.light) and {_near('x', 'y')}"))
    ends = (F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"), F.greatest("x.need", "y.need").alias("need"))
    counted = rest.select(*ends).unionByName(more.select(*ends)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")
    # the others: sets linked to the first set of the largest component under the key, and sets that differ from it alike
    crowd = scratch.save(crowded.where("not light").select("most", "fp", "root", "size", *_P).distinct(), "crowd")
    differ = scratch.save(hub_differences(crowd, texts_for(crowd.select("most", "fp"), "crowd")), "differ")
    scratch.drop("crowd-texts")
    ranked = scratch.save(ranked_differences(crowd, differ), "ranked")
    to_hub = crowd.join(differ.drop("odd"), ["most", "fp"]).where("root <> most and 9 * d <= size + hub_size").select(F.col("fp").alias("a"), F.col("most").alias("b"))
    met = scratch.save(counted.unionByName(to_hub).unionByName(apart_pairs(ranked).distinct()), "met")
    scratch.drop("differ")
    scratch.drop("ranked")
    roots = connected_components(links.unionByName(verified(met, "more")), scratch)
    placed = scratch.save(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("fp", "root").join(least, "root")
    return marked.select("doc_id", "fp").join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_limit: int = 64) -> DataFrame:
    """``docs`` with one row of each component, as ``simhash.keep_representatives``."""
    return simhash.keep_representatives(docs, text, doc_id, bucket_limit, near_duplicates, with_signature)
