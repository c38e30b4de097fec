"""Best-fit packing by linear grouping: as few sequences as possible, documents whole.

Lengths are whole numbers up to the sequence size, so that their histogram, of
bounded size, holds all that a plan needs. The driver rounds large lengths up within
groups of equal cardinality, finds configurations of these few sizes by column
generation, puts the actual lengths in their places, largest first, and lets small ones
into what is left, best fit first. The plan is a list of runs: documents of one length,
by their rank among these, go to consecutive sequences. Ranks come from prefix sums over
partitions, so neither texts nor ids move.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import batches, written

#: Large lengths are those over such a part of a sequence, in so many groups (the last: none is large); the plan with the fewest sequences is taken, the first of equals.
SETTINGS = ((2, 128), (3, 128), (6, 64), (1, 1))
#: Rows of partitions' counts that are broadcast at most (24 bytes each); more are joined.
BROADCAST_ROWS = 1_000_000


class Run(NamedTuple):
    """``n`` documents of a length, from rank ``first``: ``per`` beside each other in each sequence from ``sequence`` on, from ``offset``."""

    length: int
    first: int
    n: int
    sequence: int
    per: int
    offset: int


def grouped(counts: np.ndarray, over: int, groups: int) -> list[tuple[int, int, int]]:
    """``(rounded length, first, last)`` of groups of equal cardinality of lengths above ``over``, by places in descending order."""
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths > over]
    ends = np.cumsum(counts[lengths])
    if not len(lengths):
        return []
    n = int(ends[-1])
    edges = sorted({n * g // groups for g in range(groups + 1)}) if len(lengths) > groups else [0, *ends.tolist()]
    found: list[tuple[int, int, int]] = []
    for a, b in zip(edges, edges[1:]):
        size = int(lengths[np.searchsorted(ends, a, "right")])
        if found and found[-1][0] == size:
            found[-1] = (size, found[-1][1], b)
        else:
            found.append((size, a, b))
    return found


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how often each size) and how often each is used, by column generation on the covering programme.

    Prices of the sizes come from the current basis, and a knapsack over the capacity
    gives the configuration that is worth most; when none is worth more than a
    sequence, the fractional solution is the best one.
    """
    k = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        at = np.array(sizes)
        for room in range(min(sizes), capacity + 1):
            fits = at <= room
            worth = np.where(fits, value[np.where(fits, room - at, 0)] + price, -1.0)
            g = int(worth.argmax())
            value[room], chosen[room] = (worth[g], g) if worth[g] > value[room - 1] + 1e-12 else (value[room - 1], -1)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if chosen[room] < 0:
                room -= 1
            else:
                column[chosen[room]] += 1
                room -= sizes[chosen[room]]
        use, direction = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return list(zip(basis.T.astype(int), np.maximum(np.linalg.solve(basis, need), 0), strict=True))


class Plan:
    """Runs of a histogram of lengths, and the number of sequences."""

    def __init__(self, counts: np.ndarray, capacity: int, share: int, groups: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros(capacity + 1, np.int64)
        #: Sequences with so much room: (first, how many, offset of the room).
        self.open: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self._large(counts, grouped(counts, capacity // share, groups))
        for length in range(capacity, 0, -1):
            self._fit(length)

    def _take(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.runs.append(Run(length, int(self.used[length]), n, sequence, per, offset))
        self.used[length] += n
        self.left[length] -= n

    def _large(self, counts: np.ndarray, groups: list[tuple[int, int, int]]) -> None:
        """Whole multiples of the configurations, each place filled with actual lengths, largest first."""
        if not groups:
            return
        lengths = np.flatnonzero(counts)[::-1]
        ends = np.cumsum(counts[lengths])
        next_, last = [a for _, a, _ in groups], [b for _, _, b in groups]
        for column, times in configurations([s for s, _, _ in groups], [b - a for _, a, b in groups], self.capacity):
            m = int(times + 1e-6)
            if not m:
                continue
            # Stretches of the configuration's sequences that hold the same lengths: (from, to, offset).
            stretches = [(0, m, 0)]
            for g, places in enumerate(column):
                for _ in range(places):
                    n = min(m, last[g] - next_[g])
                    cut: list[tuple[int, int, int]] = []
                    for a, b, offset in stretches:
                        while a < min(b, n):
                            k = int(np.searchsorted(ends, next_[g] + a, "right"))
                            to = min(b, n, int(ends[k]) - next_[g])
                            self._take(int(lengths[k]), to - a, self.sequences + a, 1, offset)
                            cut.append((a, to, offset + int(lengths[k])))
                            a = to
                        if a < b:  # the group has no more
                            cut.append((a, b, offset))
                    stretches = cut
                    next_[g] += n
            for a, b, offset in stretches:
                self.open[self.capacity - offset].append((self.sequences + a, b - a, offset))
            self.sequences += m

    def _fit(self, length: int) -> None:
        """All that is left of a length, into the sequences with the least room for it; new ones where none has any."""
        while n := int(self.left[length]):
            room = next((r for r in range(length, self.capacity) if self.open[r]), 0)
            if not room:
                per = self.capacity // length
                full = max(1, n // per)
                self.open[self.capacity].append((self.sequences, full, 0))
                self.sequences += full
                room = self.capacity
            first, many, offset = self.open[room].pop()
            per = room // length
            full = min(many, n // per)
            if full:
                self._take(length, full * per, first, per, offset)
                self.open[room - per * length].append((first, full, offset + per * length))
            elif n:
                full = 1
                self._take(length, n, first, n, offset)
                self.open[room - n * length].append((first, 1, offset + n * length))
            if many > full:
                self.open[room].append((first + full, many - full, offset))


def planned(counts: np.ndarray, capacity: int) -> Plan:
    """The plan with the fewest sequences among SETTINGS."""
    total = int((counts * np.arange(len(counts))).sum())
    best: Plan | None = None
    for share, groups in SETTINGS:
        plan = Plan(counts, capacity, share, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences * capacity - total < capacity:  # no plan has fewer
            break
    assert best is not None
    return best


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = byte_bpe(path, special=True).ids
        part_id, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        end = np.array([end_id], np.uint32)
        for part in parts:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.concatenate([ids_of(text.as_py() or ""), end]).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    to = at + ((len(ids) - at - 1) % size + 1)
                    raw = ids[at:to].tobytes()
                    rows.append((part_id, doc, piece, at, to - at, zlib.crc32(raw), seen[to - at], raw if with_ids else None))
                    seen[to - at] += 1
                    at, piece = to, piece + 1
                held += 4 * len(ids)
                if held > 16 << 20 and with_ids:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return next(iter(batches([tuple(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], _NAMES)))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of all documents, and their ``ids``.

    A document is its text's ids under the ``tokenizer`` file (byte-level BPE; its
    special strings inside texts have ids of their own), then ``end_id``. Null texts are
    empty, so that every row has one id at least. A document of more than ``size`` ids is
    cut into pieces of ``size``, of which the first has what is over; others stay whole.
    Each piece lies in one sequence of at most ``size`` ids, gapless from offset 0.
    Rows that repeat a doc_id or lack one are documents like all others; an empty table
    has no pieces. Other columns are ignored. ``ids`` are little-endian unsigned 32-bit
    numbers.
    """
    spark = docs.sparkSession
    schema = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long, ids binary"
    done = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, size, end_id, with_ids), schema)
    done = written(done if with_ids else done.drop("ids"), "pieces")
    sums = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = done.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = written(by_part.select("part", "length", "n", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("base")), "bases")
    counts = np.zeros(size + 1, np.int64)
    rows = 0
    for r in base.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():  # ``size`` rows at most
        counts[r["length"]] = r["n"]
        rows += r["rows"]
    runs = planned(counts, size).runs
    plan = spark.createDataFrame(runs, "length long, first long, n long, sequence long, per long, offset long")
    base = base.select("part", "length", "base")
    ranked = done.join(F.broadcast(base) if rows <= BROADCAST_ROWS else base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank"))
    # Every rank lies in one run; their number follows from size and SETTINGS.
    found = ranked.join(F.broadcast(plan), "length").where("rank >= first and rank < first + n")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence + (rank - first) div per").alias("sequence_id"),
        (F.col("offset") + (F.col("rank") - F.col("first")) % F.col("per") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
