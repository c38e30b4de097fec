"""Chat formatting from logs of events.

An event log has a row for each event of a message: the message itself, streamed
deltas, edits, and regenerations that start it anew. The log is partitioned by
conversation and sorted by turn and sequence; each message's events fold into its
final text as they stream past, and the message is rendered at once. So a
conversation of any length takes one message's memory.

The template marks each turn with control strings. Such strings inside texts get
a backslash after their first character, and backslashes are doubled, so that
``unescaped`` restores every text. The loss mask covers assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

#: Control strings of this template and of common others.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SPECIAL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + r"|\\")
ESCAPED = re.compile(r"\\(\\?)")
TURN = re.compile(re.escape(OPEN) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(CLOSE), re.S)
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def escaped(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text begins and ends."""
    line = escaped(role).replace("\n", "\\\n")
    head = f"{OPEN}{line}\n"
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def fold(events: Iterator[tuple[str, str | None, str | None]]) -> Iterator[tuple[str, str]]:
    """Final messages (role, text) of one turn from its events (kind, role, text) in order.

    ``message`` begins a message; ``delta`` adds to the last one (or begins one),
    ``edit`` replaces its text, ``regenerate`` empties it for what follows.
    """
    role, parts = None, None
    for kind, who, text in events:
        if kind == "message" or parts is None:
            if parts is not None:
                yield role or "", "".join(parts)
            role, parts = who, []
        if kind in ("edit", "regenerate"):
            parts = []
        if text:
            parts.append(text)
    if parts is not None:
        yield role or "", "".join(parts)


def _rows(parts: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(part.column(c).to_pylist() for c in range(columns)), strict=True)


def _format(loss_role: str):
    names = ["conv_id", "part", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, place, last = 0, 0, ()
        for (conv, _), events in groupby(_rows(parts, 6), key=lambda r: (r[0], r[1])):
            place = place if last == (conv,) else 0
            last = (conv,)
            for role, text in fold((r[3], r[4], r[5]) for r in events):
                formatted, start, end = render(role, text)
                out.append((conv, place, formatted, *((start, end) if role == loss_role else (None, None))))
                place += 1
                held += len(formatted)
                if held > 1 << 20 or len(out) >= 4096:
                    yield from batches([tuple(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)
                    out, held = [], 0
        if out:
            yield from batches([tuple(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    return run


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted parts ``(conv_id, part, formatted, loss_start, loss_end)``, one for each message, of all conversations of an event log.

    ``events`` has the columns of EVENTS; rows sort by conv_id, turn, seq, then
    kind, role and text, so that ties have one order. Nulls sort first; null roles
    and texts are empty; null conversations are one. A conversation's text is its
    parts joined in order; the loss mask of a part covers ``[loss_start, loss_end)``
    in code points. The result is partitioned by conversation, in order. Other
    columns are ignored.
    """
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return (
        events.select(*names)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
        .mapInArrow(_format(loss_role), "conv_id long, part long, formatted string, loss_start long, loss_end long")
    )


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for conv, rows in groupby(_rows(parts, 5), key=lambda r: r[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        for _, _, formatted, start, end in rows:
            size += len(formatted)
            for role, text in TURN.findall(formatted):
                n += 1
                turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
            if start is not None:
                text = unescaped(formatted[start:end])
                chars += len(text)
                loss.update(text.encode())
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        if len(out) >= 4096:
            yield from _digests(out)
            out = []
    if out:
        yield from _digests(out)


def _digests(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield from batches([tuple(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from what ``format_conversations`` gave, in its order."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which each row is a whole message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that a chat service would have written of them.

    By conversation and turn a message comes whole, in deltas, after a draft that is
    edited or regenerated, or both. Only its first event names the role. The log has no order
    of its own: a row's events have sequence numbers of their own, so that
    rows that repeat a turn stay messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    a, b, c = F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, third * 2 + 1, F.length(text))
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    none = F.lit(None).cast("string")
    ways = [
        [event("message", F.col("text"))],
        [event("message", a), event("delta", b), event("delta", c)],
        [event("message", F.reverse(text)), event("regenerate", none), event("delta", F.concat(a, b)), event("delta", c)],
        [event("message", F.concat(a, F.lit(" sic"))), event("edit", text)],
        [event("message", c), event("edit", F.lit("withdrawn")), event("delta", b), event("regenerate", none), event("delta", a), event("delta", F.concat(b, c))],
        [event("message", none), event("delta", F.lit("?")), event("edit", a), event("delta", b), event("delta", c)],
    ]
    way = F.pmod(F.coalesce("conv_id", F.lit(0)) * 31 + F.coalesce("turn", F.lit(0)), F.lit(len(ways)))
    events = F.array(*ways[0])
    for k, some in enumerate(ways[1:], 1):
        events = F.when(way == k, F.array(*some)).otherwise(events)
    told = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    listed = told.select("conv_id", "turn", "row", "role", F.posexplode(events).alias("k", "e"))
    seq = F.col("row") * 8 + F.col("k")
    return listed.select("conv_id", "turn", seq.alias("seq"), "e.kind", F.when(F.col("k") == 0, F.col("role")).alias("role"), "e.text")
