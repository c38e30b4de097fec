"""Suffix-array dedup: bytes covered by strings that also start in an earlier document are removed.

Suffix arrays of everything, merged pair of shards by pair, cost the square of
the number of shards. Here every shard first lists anchors, and only stretches
whose anchors meet elsewhere get suffix arrays:

1. The anchor of a ``length``-byte string is the smallest hash among its
   ``GRAM``-byte substrings, so equal strings have equal anchors. Starts of one
   document that follow each other with one anchor are a run; the bytes of its
   strings are a segment. In a shard (a part of a task) equal segments keep the
   smallest document; in later ones all starts of the segment are removed.
2. Runs meet by anchor, sorted, and stream past: again the first document of a
   segment stands for it. An anchor with one segment only is settled.
3. Anchors with several segments (the edges of what repeats, and chance meetings)
   get their bytes. Shards of whole anchors build a suffix array by
   Larsson-Sadakane refinement in numpy, common prefixes by Kasai's pass run over
   all segments in step, and take the smallest document of each group of suffixes
   with ``length`` common bytes. An anchor too large for one shard is cut, and
   its shards' sorted strings are merged by binary search.
4. Removed starts meet their document, where each segment's hash is checked
   again, and become removed bytes.

Equality before step 3 is by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batches, mix, steps, text_bytes, written

#: Bytes of an anchor's substring; a shard's runs, and its segments' bytes.
GRAM = 20
SHARD_RUNS = 1_500_000
SHARD_BYTES = 2_000_000
#: Segments, and their bytes, beyond which an anchor's strings meet one by one.
HOT_RUNS = 1_000
HOT_BYTES = 4_000_000
#: A run's start and count in one number; longer runs are cut.
COUNT_BITS = 20


def runs(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, segment hash, value index, start within the value and count of all runs of starts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    rolling = Rolling(data)
    spots = np.arange(n - GRAM + 1)
    low = rolling(spots, spots + GRAM)
    window, have = length - GRAM + 1, 1
    first = low
    while have < window:
        shift = min(have, window - have)
        low = np.minimum(low[: len(low) - shift], low[shift:])
        have += shift
    del first
    size = np.diff(at)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none, none, none, none, none
    # Starts whose string stays within its value, and where a run begins.
    allowed = np.zeros(n + 1, np.int8)
    np.add.at(allowed, at[long], 1)
    np.add.at(allowed, at[long + 1] - length + 1, -1)
    allowed = np.cumsum(allowed[: len(low)], dtype=np.int8).astype(bool)
    begins = np.empty(len(low), bool)
    begins[0] = True
    begins[1:] = (low[1:] != low[:-1]) | ~allowed[:-1]
    begins[at[long]] = True
    begins &= allowed
    start = np.flatnonzero(begins)
    value = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), at[value + 1] - length + 1)
    most = (1 << COUNT_BITS) - 1
    if (end - start).max() > most:
        pieces = -(-(end - start) // most)
        value, base = np.repeat(value, pieces), np.repeat(start, pieces)
        step = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.repeat(end, pieces)
        start = base + step * most
        end = np.minimum(start + most, stop)
    return low[start], rolling(start, end + length - 1), value, start - at[value], end - start


def _runs(length: int):
    """Rows (key, seg, doc, run); key is null where the start of ``run`` is removed."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, seg, doc, run = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, seg, key))
        key, seg, doc, run = key[order], seg[order], doc[order], run[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
        later = doc != doc[head][np.cumsum(head) - 1]
        yield from batches(
            [(pa.array(key.view(np.int64), mask=later), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(run))],
            ["key", "seg", "doc", "run"],
        )

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = text_bytes(part.column(1))
            for i, j in steps(at):
                key, seg, value, start, count = runs(raw[at[i] : at[j]], at[i : j + 1] - at[i], length)
                if len(key):
                    held.append((key, seg, ids[i + value], start << COUNT_BITS | count))
                    n += len(key)
                if n > SHARD_RUNS:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return go


def _meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, segment and document stream past: removed starts keep a null key, segments still open keep theirs."""
    state = None  # of the last row: key, segment, its first document; and rows of the key's first segment while it has no other
    waiting: list[np.ndarray] = []
    for part in parts:
        valid = part.column(0).is_valid().to_numpy(zero_copy_only=False)
        key = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        seg, doc, run = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
        out = [np.stack([np.zeros(int((~valid).sum()), np.int64), seg[~valid], doc[~valid], run[~valid], np.zeros(int((~valid).sum()), np.int64)])]
        if valid.any():
            key, seg, doc, run = key[valid], seg[valid], doc[valid], run[valid]
            new_key = np.ones(len(key), bool)
            new_seg = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_seg[1:] = new_key[1:] | (seg[1:] != seg[:-1])
            same = state is not None and key[0] == state[0]
            if same:
                new_key[0] = False
                new_seg[0] = seg[0] != state[1]
            low = np.concatenate([[state[2] if state else 0], doc[new_seg]])[np.cumsum(new_seg)]
            removed = doc != low
            rows = np.stack([key, seg, doc, run, np.ones(len(key), np.int64)])
            gone = rows[:, removed]
            gone[4] = 0
            out.append(gone)
            group = np.cumsum(new_key)  # 0: the key that the last batch ended with
            segments = np.bincount(group, weights=new_seg, minlength=group[-1] + 1)
            several = segments[group] > 1
            if same:
                several[group == 0] = segments[0] > 0 or not waiting
                if segments[0] > 0 and waiting:
                    out += waiting
                    waiting = []
                elif segments[0] == 0 and waiting:
                    waiting.append(rows[:, (group == 0) & ~removed])
            if group[-1] > 0:
                end = group == group[-1]
                waiting = [] if several[-1] else [rows[:, end & ~removed]]
            out.append(rows[:, several & ~removed])
            state = (key[-1], seg[-1], low[-1])
        key, seg, doc, run, open_ = np.concatenate(out, axis=1)
        if len(key):
            yield from batches([(pa.array(key, mask=open_ == 0), pa.array(seg), pa.array(doc), pa.array(run))], ["key", "seg", "doc", "run"])


def _meet_weighed(length: int, most_runs: int, most_bytes: int):
    """``_meet`` with a column ``hot``: whether the row's anchor has more open segments, or bytes of them, than these."""

    def batch(rows: np.ndarray, hot: np.ndarray, valid: bool = True) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            key = pa.array(rows[0], mask=np.full(rows.shape[1], not valid))
            yield from batches([(key, *(pa.array(x) for x in rows[1:]), pa.array(hot))], ["key", "seg", "doc", "run", "hot"])

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last anchor, held until it is over or hot; how many there were, and their bytes.
        held, runs_, load = np.zeros((4, 0), np.int64), 0, 0
        last = None
        for part in _meet(parts):
            open_ = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows = np.stack([part.column(0).fill_null(0).to_numpy(zero_copy_only=False), *(part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))])
            yield from batch(rows[:, ~open_], np.zeros(int((~open_).sum()), bool), False)
            rows = rows[:, open_]
            if not rows.shape[1]:
                continue
            head = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            size = np.diff(np.append(head, rows.shape[1]))
            n, bytes_ = size.copy(), np.add.reduceat((rows[3] & (1 << COUNT_BITS) - 1) + length - 1, head)
            if rows[0, 0] == last:
                n[0] += runs_
                bytes_[0] += load
            else:
                yield from batch(held, np.zeros(held.shape[1], bool))
                held = held[:, :0]
            hot = (n > most_runs) | (bytes_ > most_bytes)
            if len(head) > 1 or hot[0]:
                yield from batch(held, np.full(held.shape[1], hot[0]))
                held = held[:, :0]
            end = rows.shape[1] if hot[-1] else head[-1]
            yield from batch(rows[:, :end], np.repeat(hot, size)[:end])
            held = np.concatenate([held, rows[:, end:]], axis=1)
            last, runs_, load = rows[0, -1], n[-1], bytes_[-1]
        yield from batch(held, np.zeros(held.shape[1], bool))

    return go


def _bytes_of(length: int):
    """Of documents with their open runs: each run's bytes, where they have the segment's hash.

    Of hot anchors' runs: a row without bytes for each string, with its hash as key
    and segment; no key if a smaller document of the batch has the string.
    """
    names = ["key", "seg", "doc", "run", "bytes"]

    def strings(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, key))
        key, doc, run = key[order], doc[order], start[order] << COUNT_BITS | 1
        head = np.append(True, key[1:] != key[:-1])
        later = doc != doc[head][np.cumsum(head) - 1]
        yield from batches([(pa.array(key, mask=later), pa.array(key), pa.array(doc), pa.array(run), pa.nulls(len(key), pa.binary()))], names)

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            apart: list[tuple[np.ndarray, ...]] = []
            for doc, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "open")), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                got = np.array([(x["key"], x["seg"], x["run"], x["hot"]) for x in wanted], np.int64)
                start, end = got[:, 2] >> COUNT_BITS, (got[:, 2] >> COUNT_BITS) + (got[:, 2] & (1 << COUNT_BITS) - 1) + length - 1
                fits = end <= len(data)
                hashed = Rolling(data)
                fits[fits] = hashed(start[fits], end[fits]).view(np.int64) == got[fits, 1]
                hot = fits & (got[:, 3] == 1)
                if hot.any():
                    n = end[hot] - start[hot] - length + 1
                    at = np.repeat(start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    apart.append((hashed(at, at + length).view(np.int64), np.full(len(at), doc), at))
                fits &= ~hot
                rows += [(int(k), int(s), doc, int(r), data[a:b].tobytes()) for (k, s, r, _), a, b in zip(got[fits], start[fits], end[fits], strict=True)]
            if apart:
                yield from strings(apart)
            if rows:
                columns = zip(*rows, strict=True)
                yield from batches([tuple(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names)

    return go


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` (0 to 256) in order.

    Larsson-Sadakane: the rank of a suffix is the last place of its group; each
    round doubles the compared length and sorts only groups that have several.
    The order is total, which Kasai's pass relies on.
    """
    n, have = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(have, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(have):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key, kind="stable")

    def ranked(places: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The last place of each group; ``same``: a place belongs with the one before it."""
        last = np.append(~same[1:], True)
        ends = places[last]
        return ends[np.cumsum(np.append(0, last[:-1]))]

    sorted_key = key[order]
    same = np.append(False, sorted_key[1:] == sorted_key[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = ranked(np.arange(n), same)
    open_ = same | np.append(same[1:], False)
    while open_.any():
        places = np.flatnonzero(open_)
        who = order[places]
        pair = rank[who] * (n + 2) + rank[np.minimum(who + have, n)] + 1
        by = np.argsort(pair, kind="stable")
        who, pair = who[by], pair[by]
        order[places] = who
        same = np.append(False, pair[1:] == pair[:-1])
        rank[who] = ranked(places, same)
        open_ = np.zeros(n, bool)
        open_[places] = same | np.append(same[1:], False)
        have *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Common symbols, up to ``most``, of each suffix in ``order`` with the one before it.

    Kasai's pass: the next suffix of a text keeps all but one of the symbols that
    this one had in common. All texts (``at``: their starts) take their step at once.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([symbols, np.full(most + 1, 999, symbols.dtype)])
    lcp = np.zeros(n, np.int64)
    start, size = at[:-1], np.diff(at)
    common = np.zeros(len(start), np.int64)
    alive = np.arange(len(start))
    for t in range(int(size.max(initial=0))):
        alive = alive[size[alive] > t]
        here = start[alive] + t
        there = before[here]
        common[alive[there < 0]] = 0
        going = np.flatnonzero(there >= 0)
        while len(going):
            c = common[alive[going]]
            more = (c < most) & (padded[here[going] + c] == padded[there[going] + c])
            going = going[more]
            common[alive[going]] += 1
        lcp[here] = common[alive]
        common[alive] = np.maximum(common[alive] - 1, 0)
    return lcp[order]


class Shard:
    """Segments of some anchors with their documents; finds the smallest document of each string."""

    def __init__(self, pieces: list[bytes], docs: list[int], length: int):
        self.at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        symbols = data.astype(np.int16) + 1
        symbols[self.at[1:] - 1] = 0
        size = np.diff(self.at) - 1
        order = suffix_array(symbols)
        lcp = common_prefixes(symbols, order, self.at, length)
        self.owner = np.repeat(np.arange(len(pieces)), size + 1)
        which = self.owner[order]
        whole = order + length <= self.at[which] + size[which]
        # Suffixes too short for a string lie before longer ones that they begin, or between groups: they never split one.
        group = np.cumsum(lcp < length)[whole]
        order, which = order[whole], which[whole]
        head = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        low = np.minimum.reduceat(np.array(docs, np.int64)[which], np.flatnonzero(head)) if len(group) else np.zeros(0, np.int64)
        self.first = order[head]
        self.low = low
        self.group = np.full(len(data), -1, np.int64)
        self.group[order] = np.cumsum(head) - 1
        self.length, self.data = length, data

    def strings(self) -> np.ndarray:
        """The distinct strings, sorted."""
        return np.array([self.data[a : a + self.length].tobytes() + b"\1" for a in self.first], f"S{self.length + 1}")

    def merge(self, other: Shard) -> None:
        """Each gets the other's smaller documents: binary search of its sorted strings in the other's."""
        mine, others = self.strings(), other.strings()
        if not len(mine) or not len(others):
            return
        by = np.argsort(others, kind="stable")
        place = np.minimum(np.searchsorted(others, mine, sorter=by), len(others) - 1)
        hit = np.flatnonzero(others[by[place]] == mine)
        there = by[place[hit]]
        low = np.minimum(self.low[hit], other.low[there])
        self.low[hit] = low
        other.low[there] = low

    def some_removed(self, docs: np.ndarray) -> np.ndarray:
        """Which segments have a start whose string is in a document smaller than theirs."""
        at = np.flatnonzero(self.group >= 0)
        which = self.owner[at]
        some = np.zeros(len(docs), bool)
        some[which[self.low[self.group[at]] < docs[which]]] = True
        return some

    def removed(self, k: int, doc: int, count: int) -> list[tuple[int, int]]:
        """Of segment k: where starts whose string is in a smaller document begin, and how many follow each other."""
        at = int(self.at[k])
        gone = np.concatenate([[False], self.low[self.group[at : at + count]] < doc, [False]])
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _shards(length: int):
    """Rows with bytes sorted by key and segment to removed starts (doc, run, seg)."""

    def settle(rows: list[tuple], places: list[int], docs: list[int], shard: Shard) -> list[tuple]:
        out = []
        some = shard.some_removed(np.array(docs, np.int64))
        for r in np.flatnonzero(some[places]):
            (_, _, doc, run, piece), k = rows[r], places[r]
            for offset, count in shard.removed(k, doc, run & (1 << COUNT_BITS) - 1):
                part = np.frombuffer(piece, np.uint8)[offset : offset + count + length - 1]
                seen = Rolling(part)(np.zeros(1, np.int64), np.array([len(part)]))
                out.append((doc, (run >> COUNT_BITS) + offset << COUNT_BITS | count, int(seen.view(np.int64)[0])))
        return out

    def built(rows: list[tuple]) -> tuple[list[tuple], list[int], list[int], Shard]:
        """Rows come sorted by anchor and segment; all rows of a segment have its smallest document."""
        pieces, docs, places = [], [], []
        last = None
        for row in rows:
            if row[:2] != last:
                last = row[:2]
                pieces.append(row[4])
                docs.append(row[2])
            places.append(len(pieces) - 1)
        return rows, places, docs, Shard(pieces, docs, length)

    def emit(shards: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(len(shards)):  # several only where one anchor runs over the end of a shard
            for b in range(a):
                shards[a][-1].merge(shards[b][-1])
        for shard in shards:
            if found := settle(*shard):
                doc, run, seg = zip(*found, strict=True)
                yield from batches([(pa.array(doc, pa.int64()), pa.array(run, pa.int64()), pa.array(seg, pa.int64()))], ["doc", "run", "seg"])

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shards: list[tuple] = []
        n, last = 0, None
        string, low = None, 0  # the last string of a hot anchor, and its first document
        for part in parts:
            alone = part.column("bytes").is_null().to_numpy(zero_copy_only=False)
            if alone.any():
                key = part.column("key").fill_null(0).to_numpy(zero_copy_only=False)[alone]
                later = part.column("key").is_null().to_numpy(zero_copy_only=False)[alone]
                doc, run, seg = (part.column(c).to_numpy(zero_copy_only=False)[alone] for c in ("doc", "run", "seg"))
                given = np.flatnonzero(~later)
                if len(given):
                    k, d = key[given], doc[given]
                    head = np.append(k[0] != string, k[1:] != k[:-1])
                    lows = np.concatenate([[low], d[head]])[np.cumsum(head)]
                    later[given] = d != lows
                    string, low = k[-1], lows[-1]
                if later.any():
                    yield from batches([tuple(pa.array(x[later]) for x in (doc, run, seg))], ["doc", "run", "seg"])
                part = part.filter(pa.array(~alone))
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "seg", "doc", "run", "bytes")), strict=True):
                if rows and row[0] != last and (shards or n > SHARD_BYTES):
                    yield from emit([*shards, built(rows)])
                    rows, shards, n = [], [], 0
                elif n > SHARD_BYTES:  # the anchor goes on in the next shard
                    shards.append(built(rows))
                    rows, n = [], 0
                rows.append(row)
                n += len(row[4])
                last = row[0]
        if rows:
            yield from emit([*shards, built(rows)])

    return go


def _cut(length: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, n, cut, spans, digest, kept = part.column("doc_id"), [], [], [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                raw = (text or "").encode()
                rest, removed, found = raw, 0, 0
                if gone:
                    data = np.frombuffer(raw, np.uint8)
                    got = np.array([(x["run"], x["seg"]) for x in gone], np.int64)
                    start = got[:, 0] >> COUNT_BITS
                    end = start + (got[:, 0] & (1 << COUNT_BITS) - 1) + length - 1
                    fits = end <= len(data)
                    fits[fits] = Rolling(data)(start[fits], end[fits]).view(np.int64) == got[fits, 1]
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, start[fits], 1)
                    np.add.at(edge, end[fits], -1)
                    out = np.cumsum(edge[:-1]) > 0
                    removed = int(out.sum())
                    found = int((out & ~np.append(False, out[:-1])).sum())
                    rest = data[~out].tobytes()
                n.append(len(raw))
                cut.append(removed)
                spans.append(found)
                digest.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest)
            columns = [pa.array(x, pa.int64()) for x in (n, cut, spans)]
            yield from batches([(ids, *columns, pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if texts else []))], names)

    return go


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` of every row of ``docs``.

    A byte goes if a ``length``-byte string of its text that covers it also
    starts in the text of a smaller doc_id; strings are judged on the input.
    Null texts are empty. Rows with one doc_id don't remove from each other; a
    null doc_id neither removes nor is removed from. ``kept`` (with ``texts``) has
    the remaining bytes, which may cut a character. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    keyed = docs.where(F.octet_length("text") >= length).where("doc_id is not null")
    found = keyed.mapInArrow(_runs(length), "key long, seg long, doc long, run long")
    met = written(
        found.repartition(F.coalesce("key", F.xxhash64("doc", "run")))
        .sortWithinPartitions("key", "seg", "doc")
        .mapInArrow(_meet_weighed(length, HOT_RUNS, HOT_BYTES), "key long, seg long, doc long, run long, hot boolean"),
        "met",
    )
    wanted = (
        met.where("key is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "seg", "run", "hot")).alias("open"))
    )
    settled = written(
        keyed.join(wanted, "doc_id")
        .mapInArrow(_bytes_of(length), "key long, seg long, doc long, run long, bytes binary")
        .repartition(F.coalesce("key", F.xxhash64("doc", "run")))
        .sortWithinPartitions("key", "seg", "doc")
        .mapInArrow(_shards(length), "doc long, run long, seg long"),
        "settled",
    )
    gone = (
        met.where("key is null")
        .select("doc", "run", "seg")
        .union(settled)
        .groupBy(F.col("doc").alias("doc_id"))
        .agg(F.collect_list(F.struct("run", "seg")).alias("gone"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return docs.join(gone, "doc_id", "left").mapInArrow(_cut(length, texts), schema)
