"""Line dedup by a tree of log templates of fixed depth.

A line's tokens with a digit are variable fields. The tree's levels are the token
count and the leading tokens (``DEPTH``). Below a path, the other tokens of a line
fall into blocks of a fifth of its tokens, and each block in turn counts as a
variable field: every line fits as many templates as it has blocks, and lines that
fit one template agree in four fifths of their tokens. A line under five tokens
fits itself only. A line goes if a document with a smaller id has a line that fits
one of its templates: so what recurs in different documents stays in the first.

A template is known by its signature, a sum of hashes of tokens with their places,
in which a block's tokens are replaced by those of a field. A task keeps one row
for each signature, that of its smallest document; the later ones are settled
there. The rest meet by signature, sorted, and stream past, so that neither a leaf
of the tree nor a frequent template is ever held or compared as a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batches, mix, steps, text_bytes, word_bounds, written

#: Leading tokens that a path has after the token count; a block has one token in this many of a line.
DEPTH = 3
SHARE = 5
#: The hash of a variable field, as of the token that stands for it.
FIELD = Rolling(np.frombuffer(b"<*>", np.uint8))(np.array([0]), np.array([3]))[0]
#: Signatures that a task holds.
HELD = 1_500_000
LONG = 1 << 22
_PLACE, _WIDTH, _VALUE = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def cut_lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Long values cut behind line feeds: offsets of all pieces, and each one's value and number of earlier lines there."""
    size = np.diff(at)
    if not len(size) or size.max() <= LONG:
        return at, np.arange(len(size)), np.zeros(len(size), np.int64)
    ends, value, lines = [at[:1]], [], []
    for v, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        feeds = np.flatnonzero(raw[a:b] == 10) + 1 if b - a > LONG else np.zeros(0, np.int64)
        cuts = feeds[np.flatnonzero(np.diff(feeds // LONG)) + 1] if len(feeds) else feeds
        cuts = cuts[cuts < b - a]
        ends.append(np.append(cuts, b - a) + a)
        value += [v] * (len(cuts) + 1)
        lines += [0, *np.searchsorted(feeds, cuts, "right").tolist()]
    return np.concatenate(ends), np.array(value), np.array(lines)


def signatures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with a token: value, number in it, signature of the line; and of all templates: line, signature."""
    start, end = word_bounds(data, at)
    token = Rolling(data)(start, end)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    token[digits[end] > digits[start]] = FIELD
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    value = np.searchsorted(at, start, "right") - 1
    number = feeds[start] - feeds[at[value]]
    head = np.ones(len(start), bool)
    head[1:] = (value[1:] != value[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(head)
    width = np.diff(np.append(first, len(start)))
    place = (np.arange(len(start)) - np.repeat(first, width)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + place * _PLACE), dtype=np.uint64)])
    fields = mix(FIELD + np.arange(width.max(initial=0)).astype(np.uint64) * _PLACE)
    fields = np.concatenate([np.zeros(1, np.uint64), np.cumsum(fields, dtype=np.uint64)])
    whole = sums[first + width] - sums[first]
    salt = width.astype(np.uint64) * _WIDTH
    block = width // SHARE
    n = np.where(block > 0, -(-(width - DEPTH) // np.maximum(block, 1)), 1)
    line = np.repeat(np.arange(len(first)), n)
    j = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    # A line without blocks has one that is empty.
    a = np.minimum(DEPTH + j * block[line], width[line])
    b = np.minimum(a + block[line], width[line])
    words = first[line]
    signature = whole[line] - (sums[words + b] - sums[words + a]) + (fields[b] - fields[a])
    return value[first], number[first], mix(whole + salt), line, mix(signature + salt[line])


def _earliest(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first row of each key with its smallest document, and of all rows of later documents."""
    order = np.lexsort((doc, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    low = doc[order[head]][np.cumsum(head) - 1]
    return order[head], order[doc[order] != low]


def _signatures(most: int):
    """Rows (signature, doc, later) of documents (doc_id, text); ``later``: a smaller document of this task, which holds ``most`` signatures, has it."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, whole, size, signature = (np.concatenate(x) for x in zip(*held, strict=True))
        # Equal lines are one; then equal signatures are.
        own, again = _earliest(doc, whole)
        begin = np.cumsum(size) - size
        n = size[own]
        at = np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of, signature = np.repeat(doc[own], n), signature[at]
        known, more = _earliest(of, signature)
        for s, d, later in ((whole[again], doc[again], True), (signature[more], of[more], True), (signature[known], of[known], False)):
            yield from batches([(pa.array(s.view(np.int64)), pa.array(d), pa.array(np.full(len(s), later)))], ["signature", "doc", "later"])

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = text_bytes(part.column(1))
            at, owner, _ = cut_lines(raw, at)
            for i, j in steps(at):
                value, _, whole, line, signature = signatures(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                if len(line):
                    held.append((ids[owner[i + value]], whole, np.bincount(line, minlength=len(whole)), signature))
                    n += len(line)
                if n > most:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return go


def _later(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and document: those of documents that aren't the signature's first."""
    last, low = None, 0
    for part in parts:
        signature, doc = (part.column(c).to_numpy() for c in range(2))
        later = part.column(2).to_numpy(zero_copy_only=False).copy()
        given = np.flatnonzero(~later)
        if len(given):
            s, d = signature[given], doc[given]
            head = np.concatenate([[s[0] != last], s[1:] != s[:-1]])
            lows = np.concatenate([[low], d[head]])[np.cumsum(head)]
            later[given] = d != lows
            last, low = s[-1], lows[-1]
        if later.any():
            yield from batches([(pa.array(doc[later]), pa.array(signature[later]))], ["doc", "signature"])


def _cut(names: list[str], text_at: int):
    """Rows (columns, later) without the lines that have a signature in ``later``, and with counts of lines."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(text_at)
            raw, at = text_bytes(column)
            gone = part.column(len(names))
            of = np.repeat(np.arange(len(part)), pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False))
            wanted = gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + of.astype(np.uint64) * _VALUE
            n = np.zeros(len(part), np.int64)
            dropped: dict[int, list[int]] = {}
            at, owner, before = cut_lines(raw, at)
            for i, j in steps(at):
                value, number, whole, line, signature = signatures(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                mine = owner[i + value]
                n += np.bincount(mine, minlength=len(n))
                if len(wanted):
                    lost = np.isin(whole + mine.astype(np.uint64) * _VALUE, wanted)
                    lost[line[np.isin(signature + mine[line].astype(np.uint64) * _VALUE, wanted)]] = True
                    for v, k in zip(mine[lost].tolist(), (before[i + value] + number)[lost].tolist(), strict=True):
                        dropped.setdefault(v, []).append(k)
            less = np.zeros(len(part), np.int64)
            texts = column
            if dropped:
                kept = column.to_pylist()
                for v, k in dropped.items():
                    less[v], out = len(k), set(k)
                    kept[v] = "\n".join(x for i, x in enumerate(kept[v].split("\n")) if i not in out)
                texts = pa.array(kept, pa.string())
            columns = [texts if c == text_at else part.column(c) for c in range(len(names))]
            yield from batches([(*columns, pa.array(n), pa.array(less))], [*names, "n_lines", "n_dropped"])

    return run


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines`` and ``n_dropped``, ``text`` without lines of templates that an earlier document has.

    An earlier document is one with a smaller doc_id. Tokens are separated by ASCII
    white space. Blank lines stay and aren't counted. A null text stays null, with
    no lines; rows with a null doc_id neither count nor change. Rows that repeat a
    doc_id don't drop each other's lines. Other columns stay as they are; an input
    column ``n_lines`` or ``n_dropped`` is replaced.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    gone = written(
        rows.mapInArrow(_signatures(HELD), "signature long, doc long, later boolean")
        .repartition(F.when(F.col("later"), F.xxhash64("signature", "doc")).otherwise(F.col("signature")))
        .sortWithinPartitions("signature", "doc")
        .mapInArrow(_later, "doc long, signature long"),
        "later-lines",
    )
    gone = gone.groupBy(F.col("doc").alias("gone_id")).agg(F.collect_set("signature").alias("later"))
    # Whatever the columns' names, none clashes inside.
    names = [n for n in docs.columns if n not in ("n_lines", "n_dropped")]
    inner = [f"c{k}" for k in range(len(names))]
    types = [docs.schema[n].dataType.simpleString() for n in names]
    found = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True)])
    found = found.join(gone, F.col(inner[names.index("doc_id")]) == F.col("gone_id"), "left").select(*inner, "later")
    schema = ", ".join(f"{c} {t}" for c, t in zip(inner, types, strict=True)) + ", n_lines long, n_dropped long"
    cut = found.mapInArrow(_cut(inner, names.index("text")), schema)
    return cut.select(*[F.col(c).alias(n) for n, c in zip(names, inner, strict=True)], "n_lines", "n_dropped")
