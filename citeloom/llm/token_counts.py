"""Token counts of a sentence-piece BPE vocabulary by heap-and-linked-list merging.

No identifiers are made: the count is the number of initial symbols less the
number of merges. Pieces never hold a word-start mark after another character,
nor a line feed, so texts fall into units before those that cannot merge with
each other; counts of short units are kept for a while in each Python worker. A long
unit is cut where no piece has its two characters side by side, since nothing merges
there either.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, in_pieces

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Characters of units that are kept, and of those that aren't cut; from LONG on merging works in arrays of numbers.
SHORT, LONG = 64, 100_000


def ranked_pieces(model: str) -> dict[str, int]:
    """Pieces that merging may make, by rank: higher scores first, equal scores alike."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    normal = [k for k in range(len(sp)) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    rank = {s: r for r, s in enumerate(sorted({sp.get_score(k) for k in normal}, reverse=True))}
    return {sp.id_to_piece(k): rank[sp.get_score(k)] for k in normal}


class UnitCounts(dict):
    """Token counts by unit."""

    def __init__(self, pieces: dict[str, int], most: int = 1_000_000):
        super().__init__()
        self.pieces, self.most = pieces, most
        inner = (p for p in pieces if "\n" in p or MARK in p.lstrip(MARK))
        if next(inner, None) is not None:
            raise ValueError("this vocabulary has pieces over the ends of units")

        self.beside = {a + b for p in pieces for a, b in zip(p, p[1:])}

    def __missing__(self, unit: str) -> int:
        if len(unit) > SHORT:
            return sum(map(self.count, self.parts(unit)))
        if len(self) >= self.most:
            self.clear()
        n = self[unit] = self.count(unit)
        return n

    def parts(self, unit: str) -> Iterator[str]:
        """A unit cut between characters that are side by side in no piece."""
        start, beside = 0, self.beside
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in beside:
                yield unit[start:k]
                start = k
        yield unit[start:]

    def count(self, unit: str) -> int:
        """Repeatedly merge the adjacent pair of the lowest rank, the leftmost of equals."""
        if len(unit) >= LONG:
            return self.count_long(unit)
        get = self.pieces.get
        n = len(unit)
        symbol = list(unit)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # Characters outside the vocabulary are as many symbols as bytes.
        count = n + sum(len(c.encode()) - 1 for c in symbol if c not in self.pieces)
        heap = [r << 32 | i for i in range(n - 1) if (r := get(unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if symbol[i] is None or (j := after[i]) >= n or get(both := symbol[i] + symbol[j]) != top >> 32:
                continue  # one of the two has merged since
            count -= 1
            symbol[i], symbol[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(both + symbol[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(symbol[h] + both)) is not None:
                heappush(heap, r << 32 | h)
        return count

    def count_long(self, unit: str) -> int:
        """The same by some twenty bytes a character: a symbol is its range of the unit, and the pairs at first come as places by rank, in order."""
        get, n = self.pieces.get, len(unit)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        count = n + sum((len(c.encode()) - 1) * unit.count(c) for c in set(unit) if c not in self.pieces)
        first: dict[int, array] = {}
        for i in range(n - 1):
            if (r := get(unit[i : i + 2])) is not None:
                first.setdefault(r, array("i")).append(i)
        given, later = dict.fromkeys(first, 0), {r: [] for r in first}
        ranks = sorted(first)

        def push(r: int | None, i: int) -> None:
            if r is None:
                return
            if r not in later:
                later[r] = []
                heappush(ranks, r)
            heappush(later[r], i)

        while ranks:
            r = ranks[0]
            own, k, more = first.get(r, ()), given.get(r, 0), later[r]
            if k < len(own) and not (more and more[0] < own[k]):
                i, given[r] = own[k], k + 1
            elif more:
                i = heappop(more)
            else:
                heappop(ranks)
                del later[r]
                first.pop(r, None)
                given.pop(r, None)
                continue
            j = after[i]
            if not j or j >= n or get(unit[i : after[j]]) != r:
                continue  # one of the two has merged since
            count -= 1
            k = after[i] = after[j]
            after[j] = 0
            if k < n:
                before[k] = i
                push(get(unit[i : after[k]]), i)
            if (h := before[i]) >= 0:
                push(get(unit[h:k]), h)
        return count

    def of_text(self, text: str) -> int:
        """As the library counts: a mark before the text, spaces as marks, nothing for an empty text."""
        if not text:
            return 0
        total = 0
        for piece in in_pieces(MARK + text.replace(" ", MARK), MARK):
            total += sum(map(self.__getitem__, UNIT.findall(piece)))
        return total


_counts: dict[str, UnitCounts] = {}


def _count(model: str, limit: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counts:
            _counts[model] = UnitCounts(ranked_pieces(model))
        of_text = _counts[model].of_text
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = [of_text(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            columns = [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield from batches([tuple(columns)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    ``model``: path of a sentence-piece BPE model without normalisation, on every
    executor. Control strings inside texts are ordinary text. Null texts are
    empty and have no tokens; a null doc_id stays null. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _count(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
