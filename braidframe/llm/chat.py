"""Chat formatting from event logs.

A conversation is a log of events.  The logs are dealt out by conversation and
sorted by sequence number; one pass over each partition folds a conversation's
events into its final messages and renders them.  Only the messages of one
conversation are held at a time.

Events (column ``op``; null means ``message``):

* ``message``: a whole message (``role``, ``text``), named by ``target`` if given;
* ``delta``: ``text`` is appended to message ``target``, which the first delta makes;
* ``edit``: the text of message ``target`` becomes ``text``;
* ``regenerate``: message ``target`` is emptied (``text`` starts it anew) and all messages after it go;
* ``delete``: message ``target`` goes.

A null target means the last message.  An event on a message that isn't there
makes it (``delete`` does nothing).  Null text counts as empty, a null role as
``unknown``; rows with a null conversation form one conversation of their own.
Events of equal sequence go by role and then text, nulls first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose texts a model learns to write.
LEARNED = ("assistant",)
OUT_BYTES = 4 << 20
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without ``<|``: one more backslash between the two characters."""
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


@dataclass
class Message:
    name: str | None
    role: str
    text: list[str]


def fold(messages: list[Message], op: str | None, target: str | None, role: str | None, text: str | None) -> None:
    """Apply one event."""
    body = text or ""
    at = len(messages) - 1 if target is None else next((i for i in range(len(messages) - 1, -1, -1) if messages[i].name == target), -1)
    if op in (None, "message") or at < 0:
        if op != "delete":
            messages.append(Message(target, role if role is not None else "unknown", [body]))
    elif op == "delta":
        messages[at].text.append(body)
    elif op == "edit":
        messages[at].text = [body]
    elif op == "regenerate":
        messages[at].text = [body]
        del messages[at + 1 :]
    elif op == "delete":
        del messages[at]
    else:
        raise ValueError(f"no such event: {op}")


def render(messages: list[Message], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the stretches of it (in code points) under the loss mask."""
    parts: list[str] = []
    mask: list[tuple[int, int]] = []
    at = 0
    for m in messages:
        head, body = f"{START}{escape_role(m.role)}\n", escape("".join(m.text))
        if m.role in learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


_MASK = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def format_chats(events: DataFrame, conversation: str = "conv_id", sequence: str = "turn", role: str = "role", text: str = "text", op: str | None = None, target: str | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conversation, formatted, mask): one row per conversation; none for an empty log."""
    absent = F.lit(None).cast("string")
    rows = events.select(
        F.col(conversation).alias("conv"), F.col(sequence).alias("seq"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
        (F.col(op).cast("string") if op else absent).alias("op"), (F.col(target).cast("string") if target else absent).alias("target"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "seq", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, held, out, size, last = None, [], [], 0, None
        first = True

        def flush() -> pa.RecordBatch:
            ids, texts, masks = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, conv_type), pa.array(texts, pa.string()), pa.array([[{"s": a, "e": b} for a, b in m] for m in masks], _MASK)], names=["conv", "formatted", "mask"])

        for batch in batches:
            conv_type = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            for conv, role_, text_, op_, target_ in zip(*columns, strict=True):
                if not first and conv != last:
                    out.append((last, *render(held, learned)))
                    size += len(out[-1][1])
                    held = []
                    if size > OUT_BYTES:
                        yield flush()
                        out, size = [], 0
                first, last = False, conv
                fold(held, op_, target_, role_, text_)
        if not first:
            out.append((last, *render(held, learned)))
            yield flush()

    return dealt.mapInArrow(run, f"conv {kind}, formatted string, mask array<struct<s:bigint,e:bigint>>").withColumnRenamed("conv", conversation)


def digest(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the formatted conversations and their masks say when they are read back."""
    kind = chats.schema[conversation].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, turn_hex, loss, loss_hex, size = [], [], [], [], []
            for formatted, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = read_back(formatted)
                learned = "".join([unescape(formatted[m["s"] : m["e"]]) for m in mask])
                turns.append(len(found))
                turn_hex.append(hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in found]).encode("utf-8", "surrogatepass")).hexdigest())
                loss.append(len(learned))
                loss_hex.append(hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest())
                size.append(len(formatted))
            whole, text = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, whole), pa.array(turn_hex, text), pa.array(loss, whole), pa.array(loss_hex, text), pa.array(size, whole)], names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select(conversation, "formatted", "mask").mapInArrow(run, f"`{conversation}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
