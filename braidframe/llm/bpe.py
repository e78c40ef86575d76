"""Byte-level BPE with a pair occurrence index.

The pieces of a batch of texts that are not known yet are laid out one after
another as symbols.  An index maps each mergeable pair to all its positions
there.  Active ranks are taken from a heap in ascending order; for one rank all
positions of its pair are merged from left to right and the lists of the pairs
that appear on either side are updated.  Encoded stretches between
spaces are remembered per worker, within a bound, so one is merged once however
often it occurs.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, enter, forgettable, small_batches, trim

#: Splitting pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beside a space.
UNEVEN = regex.compile(r" \s|\s |^ | $").search
#: Remembered stretches of a worker; the memory is emptied when it is full.
MOST_PIECES = 160_000
#: Stretches longer than this are not remembered.
LONGEST_KEPT = 256
#: Bytes of texts whose new pieces are merged together, about.
BYTES_TOGETHER = 2 << 20


def byte_letters() -> list[str]:
    """The letter which stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [vocab[x] for x in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        #: pair of ids, as one number -> rank; by rank: both parts and what they make
        self.rank_of: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        made_at = dict.fromkeys(self.byte_ids, -1)
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            if made in made_at or made_at.get(a, rank) >= rank or made_at.get(b, rank) >= rank:
                raise ValueError("the merges are not in the order in which their parts are made")
            made_at[made] = rank
            self.rank_of[a << 20 | b] = rank
            self.rules.append((a, b, made))
        self.first_ids = np.array(self.byte_ids, np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            self.sizes[i] = len(token)
        self.names = [str(i) for i in range(len(self.sizes))]
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.pairs = np.array(sorted(self.rank_of), np.int64)
        self.pair_ranks = np.array([self.rank_of[k] for k in self.pairs.tolist()], np.int64)
        #: by stretch, without the space before it: (joined ids, bytes which the ids decode to); apart for a text's first stretch
        self.known: dict[str, tuple[str, bytes]] = {}
        self.known_first: dict[str, tuple[str, bytes]] = {"": ("", b"")}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        code = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((self.pairs[at] == code) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and behind which of them each piece ends; merged together through the pair occurrence index.

        No merge makes a part of an earlier one (checked when the file is read),
        so a rank that has been applied never becomes active again.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(pieces) else 0
        symbols = np.full(n + 1, -1, np.int64)  # no pair reaches over the end of a piece, nor before the first
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[:n][inner] = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, positions: np.ndarray) -> None:
            held = np.flatnonzero(ranks >= 0)
            if not len(held):
                return
            held = held[np.argsort(ranks[held], kind="stable")]
            ranks, positions = ranks[held], positions[held]
            cuts = [*np.flatnonzero(np.diff(ranks)).tolist(), len(ranks) - 1]
            start = 0
            for rank, stop in zip(ranks[cuts].tolist(), cuts, strict=True):
                if rank in index:
                    index[rank].append(positions[start : stop + 1])
                else:
                    index[rank] = [positions[start : stop + 1]]
                    heapq.heappush(active, rank)
                start = stop + 1

        enter(self.ranks(symbols[: n - 1], symbols[1:n]) if n else np.zeros(0, np.int64), np.arange(max(0, n - 1)))
        while active:
            rank = heapq.heappop(active)
            a, b, made = self.rules[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]  # some are listed from an earlier state
            if a == b and len(at) > 1:  # of a row of equal symbols every other pair, from the left
                new = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = made, -2
            right = after[gone]
            after[at] = right
            before[right] = at
            left = before[at]
            enter(self.ranks(np.concatenate([symbols[left], np.full(len(at), made)]), np.concatenate([np.full(len(at), made), symbols[right]])), np.concatenate([left, at]))
        left = symbols[:n] >= 0
        return symbols[:n][left], np.cumsum(left)[ends]

    def split(self, text: str) -> list[str]:
        """Pieces of a text; a special token's string is a piece of its own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.special_split.split(text)):
            out += [part] if k % 2 else self.find(part)
        return out

    def stretches(self, text: str) -> list[str]:
        """Cut before single spaces between two characters that are no white space.

        The pattern never joins what lies on both sides of such a cut, so the
        pieces of a stretch do not depend on its neighbours.
        """
        parts = text.split(" ")
        if len(parts) == 1:
            return [text]
        out = [parts[0]]
        out += [" " + p for p in parts[1:]]
        if UNEVEN(text):
            joined = [out[0]]
            for left, right in zip(parts, out[1:], strict=False):
                if left and not left[-1].isspace() and right[1:] and not right[1].isspace():
                    joined.append(right)
                else:
                    joined[-1] += right
            out = joined
        if self.special_split is not None and any(" " in s for s in self.special):
            return [text]
        return out

    def learn(self, stretches: list[str]) -> list[tuple[str, bytes]]:
        """(joined ids, bytes which the ids decode to) of each stretch."""
        pieces: list[str] = []
        stops: list[int] = []  # behind which piece each stretch ends
        for s in stretches:
            if s.isalpha() or (s[:1] == " " and s[1:].isalpha()):
                pieces.append(s)
            else:
                pieces += self.split(s)
            stops.append(len(pieces))
        special = self.special if self.special and not self.special.keys().isdisjoint(pieces) else {}
        ids, ends = self.merge([b"" if p in special else p.encode("utf-8", "surrogatepass") for p in pieces])
        if special:  # such a piece was left empty; its id goes where it stood
            at = [k for k, p in enumerate(pieces) if p in special]
            ids = np.insert(ids, ends[at], [special[pieces[k]] for k in at])
            ends = ends + np.searchsorted(at, np.arange(len(pieces)), side="right")
        each = ids.tolist()
        names, raw = list(map(self.names.__getitem__, each)), self.decode_bytes(each)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], stops]).astype(np.int64)]
        bytes_before = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].tolist()
        ends = ends.tolist()
        return [(",".join(names[a:b]), raw[x:y]) for a, b, x, y in zip(ends, ends[1:], bytes_before, bytes_before[1:], strict=False)]

    def encode_many(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes which they decode to."""
        known, first = self.known, self.known_first
        if len(known) > MOST_PIECES:
            known.clear()
        if len(first) > MOST_PIECES:
            first.clear()
            first[""] = ("", b"")
        found: list[list | None] = []
        cut: dict[int, list[str]] = {}
        missing: set[str] = set()
        missing_first: set[str] = set()
        for i, text in enumerate(texts):
            parts = text.split(" ")
            row = list(map(known.get, parts))
            row[0] = first.get(parts[0])
            if None in row:
                cut[i] = parts
                missing.update(parts[1:])
            found.append(row)
        missing.difference_update(known)
        uneven = {p for p in missing if not p or p[0].isspace() or p[-1].isspace()}
        missing -= uneven
        odd: dict[int, list[str]] = {}
        for i, parts in cut.items():
            if not uneven.isdisjoint(parts[1:]) or (parts[0] and parts[0][-1].isspace()):
                odd[i] = self.stretches(texts[i])
                found[i] = None
            else:
                found[i] = parts
                if parts[0] not in first:
                    missing_first.add(parts[0])
        rest, starts, whole = list(missing), list(missing_first), list({s for c in odd.values() for s in c})
        if rest or starts or whole:
            learned = self.learn([*(" " + p for p in rest), *starts, *whole])
            known.update(zip(rest, learned, strict=False))
            first.update(zip(starts, learned[len(rest) :], strict=False))
            whole_of = dict(zip(whole, learned[len(rest) + len(starts) :], strict=True))
        out = []
        for i, row in enumerate(found):
            if row is None:
                row = [whole_of[s] for s in odd[i]]
            elif i in cut:
                row = list(map(known.get, row))
                row[0] = first[cut[i][0]]
            found[i] = None
            ids, raw = zip(*row, strict=True)
            line = ",".join(ids)
            out.append((line if ids[0] and "" not in ids else ",".join(filter(None, ids)), b"".join(raw)))
        for p in rest:
            if len(p) > LONGEST_KEPT:
                del known[p]
        for p in starts:
            if len(p) > LONGEST_KEPT:
                del first[p]
        return out

    def encode(self, text: str) -> list[int]:
        line = self.encode_many([text])[0][0]
        return [int(i) for i in line.split(",")] if line else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


forgettable(codec.cache_clear)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns ``keep``, then n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    ``path`` names a vocabulary file that every executor has.  A null text
    counts as empty: no tokens, the digests of nothing.  Rows stay one to one;
    an empty table gives no rows.  Decoding joins the bytes which the ids stand
    for and replaces what is no UTF-8.
    """
    narrow = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(["ids array<int>, decoded string"] if with_ids else [])])
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def step(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the remembered stretches are many small objects
        encoded = iter(codec(path).encode_many([t for b in batches for t in b.column(len(keep)).to_pylist()]))
        gc.enable()
        for batch in batches:
            counts, ids_hex, text_hex, ids, decoded = [], [], [], [], []
            for line, raw in islice(encoded, batch.num_rows):
                back = raw.decode("utf-8", "replace")
                counts.append(line.count(",") + 1 if line else 0)
                ids_hex.append(hashlib.sha256(line.encode()).hexdigest())
                text_hex.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in line.split(",")] if line else [])
                    decoded.append(back)
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), *more], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in small_batches(batch, "__text"):
                held.append(part)
                size += part.nbytes
                if size >= BYTES_TOGETHER:
                    yield from step(held)
                    held, size = [], 0
        if held:
            yield from step(held)
        trim()

    bound_batches(docs.sparkSession)
    return narrow.mapInArrow(run, schema)
