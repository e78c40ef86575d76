"""Removal of long repeated strings with longest-previous-factor arrays.

A string of ``LENGTH`` bytes that starts at two places is a repeat.  A suffix
array over a whole corpus does not fit a task, so suffixes are first dealt out
by content: each window of ``LENGTH`` bytes is given to the 64-byte string in it
with the least hash (the leftmost of equals), its anchor.  Equal windows have
equal anchors at equal places, so all copies of a window meet under one anchor,
and no two anchors share a window.  The windows of one anchor in a text start at
consecutive bytes; together they are a segment.

Segments that are equal as a whole are counted in Spark without their bytes
(combined before the shuffle): all their windows repeat.  The others of an
anchor with several kinds of segment are fetched and brought into suffix order,
from the last byte to the first, one column of aligned suffixes after another.
There the previous and the next smaller position in suffix order give each
suffix's longest previous factor: the longer of what it shares with either.  A
factor of ``LENGTH`` bytes or more is an earlier copy, which ends where the
factor does.  Positions counted backwards give the longest next factors in the
same way; an earlier copy and a later one make a repeat.

An anchor with very many kinds of segment is settled by counting window hashes
in Spark, which needs no task to hold them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, session_of

LENGTH, GRAM = 400, 64
#: Segments of one anchor that a task brings into suffix order together; of more, the windows are counted in Spark.
MOST_SEGMENTS = 8_192
#: Segments of several anchors that are handled in one go.
SEGMENTS_PER_STEP = 4_096
_C = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position (bytes behind the end count as zero)."""
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    n = len(data)
    eight = np.ndarray((n + GRAM - 8,), "<u8", padded, strides=(1,))
    g = eight * _C[0]
    g ^= g >> np.uint64(32)
    for width, c in ((8, _C[1]), (16, _C[2]), (32, _C[3])):
        g = g[:-width] * c + g[width:]
        g ^= g >> np.uint64(31)
    g = g[:n] * _C[4]
    g ^= g >> np.uint64(32)
    return g


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window, further windows, anchor's place in the segment, anchor hash) of all segments."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sizes = np.array([len(texts[i]) for i in long])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    g = gram_hashes(data)
    bits = max(1, int(len(data)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    keyed = (g & ~mask) | np.arange(len(data), dtype=np.uint64)
    least = sliding_min(keyed, length - GRAM + 1)
    windows = sizes - length + 1
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    at = np.arange(windows.sum()) + first
    anchor = (least[at] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    owner = np.searchsorted(starts, at[new], side="right") - 1
    return np.array(long)[owner], at[new] - starts[owner], at[last] - at[new], anchor[new] - at[new], g[anchor[new]]


_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_sums(table: np.ndarray) -> np.ndarray:
    """For each row the sums of its first bytes' weights; differences between two columns tell stretches there apart."""
    columns = table.shape[1]
    powers = np.full(columns, 0x9FB21C651E98DF25, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros((len(table), columns + 1), np.uint64)
    np.cumsum(_TABLE[table] * powers, axis=1, out=sums[:, 1:])
    return sums


def window_hashes(table: np.ndarray, length: int) -> np.ndarray:
    """For each row and column the hash of the ``length`` bytes from there; only those of one column compare."""
    sums = prefix_sums(table)
    return sums[:, length:] - sums[:, :-length]


def align(bodies: list[bytes], offset: np.ndarray, length: int) -> np.ndarray:
    """Segments as rows of bytes with their anchors in one column."""
    lead = length - GRAM
    table = np.zeros((len(bodies), lead + length), np.uint8)
    for i, (body, o) in enumerate(zip(bodies, offset.tolist(), strict=True)):
        table[i, lead - o : lead - o + len(body)] = np.frombuffer(body, np.uint8)
    return table


def _common(sums: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray, c: int, length: int) -> np.ndarray:
    """How many bytes the suffixes of rows x and y from column c have in common; they agree for ``length`` at least."""
    low, high = np.full(len(x), length, np.int64), np.minimum(ends[x], ends[y]) - c
    while (open_ := np.flatnonzero(low < high)).size:
        i, j, middle = x[open_], y[open_], (low[open_] + high[open_] + 1) // 2
        same = sums[i, c + middle] - sums[i, c] == sums[j, c + middle] - sums[j, c]
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)
    return low


def nearest_smaller(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest place before each with a smaller value, the least of ``common`` up to there); -1 and 0 if there is none.

    ``common[j]`` is what j shares with j - 1.  Places point to the one before
    them and jump on along the pointers of others until they stand on a smaller
    value; what they pass over is never smaller.
    """
    n = len(value)
    to, shared = np.arange(-1, n - 1), common.copy()
    todo = np.arange(n)
    while True:
        todo = todo[(to[todo] >= 0) & (shared[todo] > 0)]
        todo = todo[value[to[todo]] >= value[todo]]
        if not len(todo):
            break
        via = to[todo]
        to[todo], shared[todo] = to[via], np.minimum(shared[todo], shared[via])
    return to, np.where(to >= 0, shared, 0)


def longest_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix: what it shares with the previous or the next smaller position in suffix order."""
    before = nearest_smaller(place, common)[1]
    after = nearest_smaller(place[::-1], np.concatenate([[0], common[:0:-1]]))[1][::-1]
    return np.maximum(before, after)


def factors(table: np.ndarray, group: np.ndarray, place: np.ndarray, first: np.ndarray, more: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous and the longest next factor of each window; 0 where it is shorter than ``length``.

    Rows of ``table`` are aligned segments; row i has windows in the columns
    ``first[i]`` to ``first[i] + more[i]``.  ``group`` is its anchor, ``place``
    orders the rows by position.  The next factors are the previous ones of the
    positions counted backwards.
    """
    n, columns = len(table), length - GRAM + 1
    sums = prefix_sums(table)
    ends = first + more + length
    previous, following = np.zeros((n, columns), np.int32), np.zeros((n, columns), np.int32)
    rank = np.argsort(np.argsort(group, kind="stable"), kind="stable")
    base = group.astype(np.int64) * 256
    for c in range(table.shape[1] - 1, -1, -1):
        order = np.argsort((base + table[:, c]) * n + rank)  # suffix order of this column from that of the next
        rank[order] = np.arange(n)
        if c >= columns:
            continue
        order = order[(first[order] <= c) & (c <= first[order] + more[order])]
        if len(order) < 2:
            continue
        x, y = order[:-1], order[1:]
        near = np.flatnonzero((group[x] == group[y]) & (sums[x, c + length] - sums[x, c] == sums[y, c + length] - sums[y, c]))
        if not len(near):
            continue
        common = np.zeros(len(order), np.int64)
        common[near + 1] = _common(sums, ends, x[near], y[near], c, length)
        # only suffixes that share ``length`` bytes with a neighbour can have such a factor
        held = np.unique(np.concatenate([near, near + 1]))
        order, common = order[held], common[held]
        previous[order, c] = longest_factors(place[order], common)
        following[order, c] = longest_factors(-place[order], common)
    return previous, following


def covered(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, end column) of the stretches that factors of the given lengths cover in each row."""
    row, start = np.nonzero(reach)
    if not len(row):
        return row, start, start
    wide = 4 * reach.shape[1] + int(reach.max())
    end = np.maximum.accumulate(row * wide + start + reach[row, start])
    new = np.flatnonzero(np.concatenate([[True], row[1:] * wide + start[1:] > end[:-1]]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return row[new], start[new], end[last] - row[last] * wide


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, body); rows of equal id and key have equal texts."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"), body.cast("binary").alias("body"))


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep: str = "none", most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, key, spans): byte spans (s, e) which cover the windows that repeat, of texts that have any.

    ``keep="none"`` takes every copy, ``keep="first"`` leaves the one of the
    smallest position (id, then text hash, then byte).  Spans may overlap.  Rows
    that agree in id and text share one result; to ``keep="first"`` they are one.
    """
    if keep not in ("none", "first") or length < GRAM:
        raise ValueError(f"keep is none or first, length {GRAM} or more")
    scratch = Scratch(session_of(docs))
    rows = _keyed(docs, text, doc_id)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(2).to_pylist()
        owner, first, more, offset, h = segments(texts, length)
        if not len(owner):
            return None
        whole = [xxhash.xxh3_64_intdigest(texts[i][a : a + m + length], o) for i, a, m, o in zip(owner.tolist(), first.tolist(), more.tolist(), offset.tolist(), strict=True)]
        taken = pa.array(owner)
        seg = np.array(whole, np.uint64).view(np.int64)
        arrays = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(h.view(np.int64)), pa.array(seg), *(pa.array(x.astype(np.int32)) for x in (first, more, offset))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "h", "seg", "first", "more", "offset"])

    all_segments = scratch.save(map_arrow(rows, f"doc_id {id_type}, key bigint, h bigint, seg bigint, first int, more int, offset int", cut, "body", max_bytes=1 << 20, max_rows=4096), "segments")
    at = F.struct("doc_id", "key", "first")
    # counts are written before they are joined back: a join of two plain shuffles can be split where a key is hot
    least = F.min(at) if keep == "first" else F.lit(None)  # a struct's minimum is not aggregated by hashing
    anchors = all_segments.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"), least.cast(f"struct<doc_id:{id_type},key:bigint,first:int>").alias("least"))
    anchors = scratch.save(anchors.where("n > 1").selectExpr("h", "low = high as alike", "least"), "anchors")
    found = scratch.save(all_segments.join(anchors, "h"), "recurring")
    scratch.drop("segments")
    scratch.drop("anchors")
    # all segments of such an anchor are copies of one
    alike = found.where("alike").select("doc_id", "key", "first", "more", "least")
    mixed = found.where("not alike").drop("alike", "least")
    kinds = mixed.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "first", "more", "offset")).alias("least"))
    kinds = scratch.save(kinds, "kinds")
    # copies are dealt out by row first: a key with very many then comes from all tasks, and the join can be split there
    spread = mixed.repartition("doc_id", "key", "first")
    copies = spread.join(kinds.where("n > 1").select("h", "seg", F.struct("least.doc_id", "least.key", "least.first").alias("least")), ["h", "seg"]).select(*alike.columns)
    copies = alike.unionByName(copies)
    if keep == "first":
        copies = copies.where(~at.eqNullSafe(F.col("least")))
    spans = copies.select("doc_id", "key", F.col("first").alias("s"), (F.col("first") + F.col("more") + length).alias("e"))
    # one segment of each kind, where an anchor has several kinds
    crowds = scratch.save(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")), "crowds")
    wanted = kinds.join(crowds, "h").select("least.*", "h", (F.col("kinds") > most_segments).alias("crowded"))
    per_text = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "first", "more", "offset", "crowded")).alias("wanted"))
    source = rows.alias("r").join(per_text.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.key") == F.col("w.key"))).select("r.doc_id", "r.key", "r.body", "w.wanted")

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        owner, out = [], []
        for i, (body, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for w in want:
                owner.append(i)
                out.append((w["h"], w["first"], w["more"], w["offset"], w["crowded"], body[w["first"] : w["first"] + w["more"] + length]))
        if not out:
            return None
        taken, columns = pa.array(owner), list(zip(*out, strict=True))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "key", "h", "first", "more", "offset", "crowded", "body"])

    fetched = scratch.save(map_arrow(source, f"doc_id {id_type}, key bigint, h bigint, first int, more int, offset int, crowded boolean, body binary", fetch, "body"), "fetched")
    found_spans = f"doc_id {id_type}, key bigint, s int, e int"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows_held += b.num_rows
            if rows_held >= SEGMENTS_PER_STEP:
                whole = pa.Table.from_batches(held).combine_chunks()
                h = whole["h"].to_numpy()
                cut_at = int(np.searchsorted(h, h[-1], side="left"))  # the last anchor may go on
                if cut_at:
                    yield from _settled(whole.slice(0, cut_at), length, keep)
                    rest = whole.slice(cut_at)
                    held, rows_held = rest.to_batches(), rest.num_rows
        if held:
            yield from _settled(pa.Table.from_batches(held).combine_chunks(), length, keep)

    near = fetched.where("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h")
    spans = spans.unionByName(near.mapInArrow(settle, found_spans))
    if wanted.where("crowded").limit(1).count():
        spans = spans.unionByName(_counted(fetched.where("crowded"), id_type, length, keep))
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _settled(table: pa.Table, length: int, keep: str) -> Iterator[pa.RecordBatch]:
    h = table["h"].to_numpy()
    first, more, offset = (table[c].to_numpy().astype(np.int64) for c in ("first", "more", "offset"))
    ids = table["doc_id"].combine_chunks()
    by_id = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"))
    order = np.lexsort((first + offset, table["key"].to_numpy(), by_id))
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    lead = length - GRAM
    rows = align(table["body"].to_pylist(), offset, length)
    previous, following = factors(rows, np.unique(h, return_inverse=True)[1], place, lead - offset, more, length)
    row, start, end = covered(previous if keep == "first" else np.maximum(previous, following))
    if len(row):
        base = first[row] - (lead - offset[row])
        taken = pa.array(row)
        yield pa.RecordBatch.from_arrays([ids.take(taken), table["key"].combine_chunks().take(taken), pa.array((base + start).astype(np.int32)), pa.array((base + end).astype(np.int32))], names=["doc_id", "key", "s", "e"])


def _counted(crowded: DataFrame, id_type: str, length: int, keep: str) -> DataFrame:
    """Spans of crowded anchors: the windows' hashes are counted in Spark."""
    lead = length - GRAM

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, more, offset = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 4, 5))
        hashes = window_hashes(align(batch.column(6).to_pylist(), offset, length), length)
        row = np.repeat(np.arange(len(first)), more + 1)
        column = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1) + (lead - offset)[row]
        taken = pa.array(row)
        start = first[row] + column - (lead - offset)[row]
        return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), batch.column(2).take(taken), pa.array(column.astype(np.int32)), pa.array(hashes[row, column].view(np.int64)), pa.array(start.astype(np.int32))], names=["doc_id", "key", "h", "c", "w", "s"])

    narrow = crowded.select("doc_id", "key", "h", "first", "more", "offset", "body")
    windows = map_arrow(narrow, f"doc_id {id_type}, key bigint, h bigint, c int, w bigint, s int", step, "body")
    at = F.struct("doc_id", "key", "s")
    many = windows.groupBy("h", "c", "w").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("least")).where("n > 1")
    hit = windows.join(many, ["h", "c", "w"])
    if keep == "first":
        hit = hit.where(~at.eqNullSafe(F.col("least")))
    return hit.select("doc_id", "key", "s", (F.col("s") + length).alias("e"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep: str = "none", with_kept: bool = False, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept): one row per row of ``docs``.

    A null text counts as empty.  Repeated rows stay repeated; rows of equal id
    and text are copies of each other.  ``kept`` holds the remaining bytes.
    """
    rows = _keyed(docs, text, doc_id)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, text, doc_id, length, keep, most_segments)
    joined = rows.alias("r").join(spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.key") == F.col("s.key")), "left").select("r.doc_id", "r.body", "s.spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, counts, digests, kept = [], [], [], [], []
        for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone, at, parts = merged(found or []), 0, []
            for s, e in gone:
                parts.append(body[at:s])
                at = e
            parts.append(body[at:])
            left = b"".join(parts)
            sizes.append(len(body))
            removed.append(len(body) - len(left))
            counts.append(len(gone))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        more = [pa.array(kept, pa.binary())] if with_kept else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *more], names=names)

    return map_arrow(joined, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else ""), step, "body")
