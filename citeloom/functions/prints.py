"""Fingerprints of strings: a text that has a string has all of its fingerprints, so what lacks one needn't be read for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .text import essential, spelled

#: Bytes of a long string's runs, and runs of which the least stands for all; shorter strings are known by their runs of up to SHORT bytes.
GRAM, SPAN, SHORT = 16, 16, 8
#: Characters of a text that are spelled at once.
CHARS_AT_ONCE = 1 << 18


def kind_of(size: int) -> int:
    """Bytes of the runs by which a string of ``size`` bytes is known; 0 for an empty one, which all texts have."""
    return GRAM if size >= GRAM + SPAN - 1 else min(size, SHORT)


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x ^= np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def prints(data: bytes, kind: int) -> np.ndarray:
    """64-bit hashes of all runs of ``kind`` bytes; of long runs the least of every SPAN in a row."""
    if not kind:
        return np.zeros(1, np.uint64)
    if len(data) < (kind if kind <= SHORT else GRAM + SPAN - 1):
        return np.zeros(0, np.uint64)
    x = np.frombuffer(data + bytes(7), np.uint8).astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    if kind <= SHORT:
        return _mixed(x[: len(data) - kind + 1] & np.uint64((1 << 8 * kind) - 1), kind)
    x = _mixed(_mixed(x[: len(data) - GRAM + 1].copy(), 1) + x[8 : len(data) - GRAM + 9], kind)
    for k in (1, 2, 4, 8):
        x = np.minimum(x[:-k], x[k:])
    return x


def of_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes (quote_id, quote) as (quote_id, kind, print): the fingerprints of what every text with the quote has."""
    for batch in batches:
        ids, kinds, found = [], [], []
        for quote_id, quote in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = essential(quote).encode()
            some = np.unique(prints(data, kind_of(len(data)))).view(np.int64)
            ids.append(np.full(len(some), quote_id))
            kinds.append(np.full(len(some), kind_of(len(data))))
            found.append(some)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((ids, pa.int64()), (kinds, pa.int32()), (found, pa.int64()))], ["quote_id", "kind", "print"])


def _some(text: str, kinds: list[int], marked: np.ndarray) -> np.ndarray:
    """The fingerprints of a text that are ``marked``, a part of the text at a time."""
    mask = np.uint64(len(marked) * 64 - 1)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)]
    tail = b""
    for at in range(0, max(len(text), 1), CHARS_AT_ONCE):
        data = tail + spelled(text[at : at + CHARS_AT_ONCE]).encode()
        tail = data[-(GRAM + SPAN - 2) :]
        for kind in kinds:
            x = prints(data, kind)
            bit = x & mask
            out.append(np.unique(x[marked[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0]))
    return np.unique(np.concatenate(out))


def of_texts(kinds: list[int], marked: np.ndarray) -> Callable:
    """Texts (id, text) as (print, id): their fingerprints of some kinds whose bit is set in ``marked``, a power of two of 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(batch.column(1)):
                some = _some(text.as_py() or "", kinds, marked).view(np.int64)
                ids.append(np.full(len(some), k))
                found.append(some)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), batch.column(0).take(pa.array(np.concatenate(ids), pa.int64()))], ["print", "id"])

    return run
