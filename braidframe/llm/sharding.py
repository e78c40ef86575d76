"""Sharding by minimax contiguous partition, in DataFrame functions only.

Atomic groups (rows of equal text) are laid out in the order of a 64-bit hash of
the text.  The smallest feasible shard capacity is found by binary search; each
capacity is checked greedily over the ordered group sizes, and the shards are
cut where the greedy check of the final capacity cuts.

The order is summarised level by level: first the byte sums of 4096 ranges of
the hash, then of the 256 ranges within each range in which a cut may fall, and
so on until those ranges hold one group each.  A range that is not opened yet
bounds the answer from both sides: as a liquid (capacity cannot be smaller) and
as an atom (it need not be larger).  The driver holds these sums only, whose
number is bounded by the shards and not by the rows.

A group at least as large as an even share of what is left gets a shard of its
own first (there are fewer of them than shards), else one such group would set
the capacity and leave other shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, session_of

TOP_BITS, STEP_BITS = 12, 8
#: Rows whose places in a shard are numbered by one task, about.
ROWS_PER_CELL = 50_000


@dataclass
class Range:
    """Groups whose ordered hash starts with ``prefix`` (``bits`` bits)."""

    prefix: int
    bits: int
    size: int
    groups: int


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """Starts of the shards that filling up to ``capacity`` makes (atoms not above it)."""
    sums, starts, at = [0, *accumulate(sizes)], [], 0
    while at < len(sizes):
        starts.append(at)
        at = max(at + 1, bisect_right(sums, sums[at] + capacity) - 1)
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the least capacity that needs no more than ``shards`` shards."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _ordered(h: Column) -> Column:
    """The signed hash with its order made that of its unsigned bits."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(_ordered(F.col("h")), 64 - bits)


def _open(groups: DataFrame, ranges: list[Range]) -> list[Range]:
    """The ranges within the given ones (all of the same bits), one level down."""
    bits = ranges[0].bits
    wanted = groups.where(_prefix(bits).isin([r.prefix for r in ranges]))
    rows = wanted.groupBy(_prefix(bits + STEP_BITS).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    return [Range(r.p, bits + STEP_BITS, int(r.s), r.n) for r in rows]


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first ordered hash of each shard as 64 unsigned bits) for ``groups`` (h, size), one row a group."""
    rows = groups.groupBy(_prefix(TOP_BITS).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    ranges = sorted((Range(r.p, TOP_BITS, int(r.s), r.n) for r in rows), key=lambda r: r.prefix)
    while True:
        sizes = [r.size for r in ranges]
        sums = [0, *accumulate(sizes)]
        atoms = smallest_capacity(sizes, shards)
        liquid = max([-(-sums[-1] // shards), *(r.size for r in ranges if r.groups == 1)]) if ranges else 0
        # a cut after shard j lies between where atoms fill up to `liquid` and where a liquid fills up to `atoms`
        opened: set[int] = set()
        least = greedy(sizes, max(liquid, 0)) if sizes else []
        for j in range(1, shards):
            low = sums[least[j]] if j < len(least) else sums[-1]
            first, last = bisect_right(sums, min(low, j * liquid)) - 2, bisect_right(sums, j * atoms)
            opened.update(i for i in range(max(0, first), min(len(ranges), last + 1)) if ranges[i].groups > 1)
        if not opened:
            starts = greedy(sizes, atoms) if sizes else []
            return atoms, [ranges[i].prefix << (64 - ranges[i].bits) for i in starts]
        depth = min(ranges[i].bits for i in opened)
        chosen = {i for i in opened if ranges[i].bits == depth}
        finer = _open(groups, [ranges[i] for i in sorted(chosen)])
        ranges = sorted([*(r for i, r in enumerate(ranges) if i not in chosen), *finer], key=lambda r: r.prefix << (64 - r.bits))


def large_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(h, size) of groups that are at least an even share of what is left once larger ones are gone."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    found: list[tuple[int, int]] = []
    top = [(r.h, int(r.size)) for r in groups.orderBy(F.desc("size"), "h").limit(shards).collect()]
    left = int(total)
    for h, size in top:
        if len(found) >= shards - 1 or size * (shards - len(found)) < left:
            break
        found.append((h, size))
        left -= size
    return found


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of ``docs``.

    ``size`` is the UTF-8 length plus ``overhead``; a null text counts as empty
    and belongs to the group of empty texts.  Equal texts stay in one shard,
    largest shards are as small as the order allows.  Slots number a shard's
    rows from 0 without gaps; repeated rows and null ids get slots of their own.
    An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    scratch = Scratch(session_of(docs))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("h")), "rows")
    groups = scratch.save(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    large = large_groups(groups, shards)
    rest = groups.where(~F.col("h").isin([h for h, _ in large])) if large else groups
    starts = cuts(rest, shards - len(large))[1]
    signed = [s - (1 << 64) if s >= 1 << 63 else s for s in (x ^ (1 << 63) for x in starts)]
    shard = F.lit(len(large))
    for k, s in enumerate(signed[1:], 1):
        shard = F.when(F.col("h") >= F.lit(s).cast("long"), F.lit(len(large) + k)).otherwise(shard)
    for k, (h, _) in enumerate(large):
        shard = F.when(F.col("h") == F.lit(h).cast("long"), F.lit(k)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    # slots: cells of bounded size are numbered apart, then moved by the rows of the cells before them
    count = int(groups.agg(F.sum("n")).first()[0] or 0)
    cells = max(1, -(-count // (shards * ROWS_PER_CELL)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells * 4)).cast("int"))
    before = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("cell")
    before = before.select("shard", "cell", (F.sum("n").over(order) - F.col("n")).alias("before"))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h", "doc_id")) - 1)
    out = numbered.join(F.broadcast(before) if cells * 4 * shards <= 100_000 else before, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
