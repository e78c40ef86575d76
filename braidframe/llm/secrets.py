"""Secret scanning with corpus-wide ownership frequency.

A scan finds candidate values in whole texts: the three base kinds (``assign``,
``access``, ``hex``) and long mixed tokens.  The hashes of all candidates are
aggregated over the corpus by distinct repositories and distinct owners.  A value
which several owners and many repositories hold is a widely copied example
(documentation, templates); copies within few owners excuse nothing.  A value
that is no such example and looks random is taken for a live credential: its
place is added to the base spans as ``live``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, session_of

#: The base kinds in order (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more, as shorter runs are dropped
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WORDS = ("password", "passwd", "secret", "token", "api")
PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|your[_-]?|dummy|xxxx|0000000|12345678|abcdef", re.IGNORECASE)
#: Above both so many owners and so many repositories a value is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20
LEAST_ENTROPY = 3.0
#: Copied examples up to this many are sent to all tasks; more are joined.
MOST_SENT = 100_000

Span = tuple[int, int, str, int, int]  # start, end, kind, start and end of the value


def base_spans(text: str) -> list[Span]:
    """The contract's matches, by start and then by kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    """Random-looking and no placeholder."""
    return entropy(value) >= LEAST_ENTROPY and not PLACEHOLDER.search(value)


def token_spans(text: str, base: list[Span]) -> list[Span]:
    """Long tokens of letters and digits that touch no base span."""
    found = []
    for m in TOKEN.finditer(text):
        start, end, value = m.start(), m.end(), m.group()
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and looks_live(value) and not any(s[0] < end and start < s[1] for s in base):
            found.append((start, end, "live", start, end))
    return found


def value_hash(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_FOUND = "array<struct<s:int,e:int,kind:string,vs:int,ve:int,h:string,random:boolean>>"
_FOUND_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("vs", pa.int32()), ("ve", pa.int32()), ("h", pa.string()), ("random", pa.bool_())]))


def _found(text: str) -> list[dict]:
    base = base_spans(text)
    return [{"s": a, "e": b, "kind": k, "vs": c, "ve": d, "h": value_hash(text[c:d]), "random": looks_live(text[c:d])} for a, b, k, c, d in [*base, *token_spans(text, base)]]


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``found``: every candidate span of the whole text with its value's hash."""
    narrow = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), f"found {_FOUND}"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([_found(t) for t in batch.column(len(keep)).to_pylist()], _FOUND_ARROW)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keep, "found"])

    return map_arrow(narrow, schema, step, "__text")


def frequencies(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(h, repositories, owners): in how many distinct ones each value occurs; null ones count together as one."""
    each = found.select(F.explode("found").alias("f"), repository.cast("string").alias("repo"), owner.cast("string").alias("own")).select(F.col("f.h").alias("h"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("own", F.lit("")).alias("own"))
    pairs = each.groupBy("h", "repo", "own").agg(F.lit(1).alias("one"))  # combined before the shuffle
    return pairs.groupBy("h").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("own").alias("owners"))


def copied_examples(freq: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    return freq.where((F.col("owners") > most_owners) & (F.col("repositories") > most_repositories))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(doc_id, found, examples): each row's candidates and those hashes among them that are copied examples.

    Null text counts as empty; null repositories or owners count as one; rows
    with a null id are kept.  Repeated rows stay repeated and count as one
    repository.  An empty table gives no rows.
    """
    scratch = Scratch(session_of(docs))
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("__repo"), F.col(owner).cast("string").alias("__own"), F.col(text).alias("text"))
    found = scratch.save(candidates(renamed, keep=("doc_id", "__repo", "__own")), "found")
    examples = copied_examples(frequencies(found, F.col("__repo"), F.col("__own")), most_owners, most_repositories).select("h")
    # rows of the same id and the same candidates have the same examples, so this key need not be unique
    keyed = found.withColumn("rid", F.xxhash64("doc_id", "found"))
    held = keyed.select("rid", F.explode("found.h").alias("h")).distinct().join(examples, "h").groupBy("rid").agg(F.collect_list("h").alias("examples"))
    return keyed.join(held, "rid", "left").select("doc_id", "found", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def digest(scanned: DataFrame) -> DataFrame:
    """The registered query's columns from a scan: counts, digest of the base spans, all spans, live and copied values."""
    order = {k: i for i, k in enumerate((*KINDS, "live"))}
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    base = F.filter("found", lambda f: f["kind"] != "live")
    live = F.filter("found", lambda f: f["random"] & ~F.array_contains(F.col("examples"), f["h"]))
    added = F.array_distinct(F.transform(live, lambda f: F.struct(f["vs"].alias("s"), f["ve"].alias("e"), F.lit("live").alias("kind"))))
    plain = F.transform(base, lambda f: F.struct(f["s"].alias("s"), f["e"].alias("e"), f["kind"].alias("kind")))

    def line(spans: Column) -> Column:
        sorted_ = F.array_sort(F.transform(spans, lambda f: F.struct(f["s"].alias("s"), rank[f["kind"]].alias("r"), f["e"].alias("e"), f["kind"].alias("k"))))
        return F.array_join(F.transform(sorted_, lambda f: F.concat_ws(":", f["k"], f["s"], f["e"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.concat(plain, added)).alias("spans"), F.size(added).cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_copied"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", mark: str = "[SECRET]", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """``docs`` with credentials replaced by ``mark``; columns and rows stay.

    A value is left only if it is a copied example and does not look random, so
    that a real key which has been copied about goes too.  ``n_chars``, if there is such a column, follows the text.  A null text stays null.
    """
    scratch = Scratch(session_of(docs))
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("__repo"), F.col(owner).cast("string").alias("__own"), F.col(text).alias("text"))
    found = scratch.save(candidates(renamed, keep=("doc_id", "__repo", "__own")).where("size(found) > 0"), "found")
    examples = scratch.save(copied_examples(frequencies(found, F.col("__repo"), F.col("__own")), most_owners, most_repositories).select("h"), "examples")
    few = examples.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = docs.sparkSession.sparkContext.broadcast({r.h for r in examples.collect()} if few else set())
    at, columns = docs.columns.index(text), docs.columns
    if few:
        with_examples = docs.withColumn("__copied_examples", F.lit(None).cast("array<string>"))
    else:
        held = found.select("doc_id", F.explode("found.h").alias("h")).distinct().join(examples, "h").groupBy("doc_id").agg(F.collect_list("h").alias("__copied_examples")).withColumnRenamed("doc_id", "__candidate_id")
        with_examples = docs.join(held, docs[doc_id].eqNullSafe(F.col("__candidate_id")), "left").drop("__candidate_id")
    out_type = docs.schema[text].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def clean(t: str | None, own: list[str] | None) -> str | None:
        if not t:
            return t
        out, last, copied = [], 0, sent.value.union(own or ())
        for f in sorted(_found(t), key=lambda f: (f["vs"], -f["ve"])):
            if (f["random"] or f["h"] not in copied) and f["ve"] > last:
                out += [t[last : max(last, f["vs"])], mark if f["vs"] >= last else ""]
                last = f["ve"]
        return "".join(out) + t[last:] if last else t

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
        arrays = list(batch.columns[:-1])
        done = [clean(t, o) for t, o in zip(texts, own, strict=True)]
        arrays[at] = pa.array(done, arrays[at].type)
        if "n_chars" in columns:
            k = columns.index("n_chars")
            before = arrays[k].to_pylist()
            arrays[k] = pa.array([len(d) if d != t else n for d, t, n in zip(done, texts, before, strict=True)], arrays[k].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    if out_type != "string":
        raise TypeError(f"{text} must be a string column")
    return map_arrow(with_examples, schema, step, text)
