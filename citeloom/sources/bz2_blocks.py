"""Blocks of bz2 files, each read on its own, so that one file is read by many tasks.

A block begins with a mark of 48 bits at any bit, and ends where the next block or the
stream's end begins. Put behind a stream's head and before a tail with the block's own
checksum, it is a whole stream. Marks that come up by chance inside a block show in that
the cut doesn't decompress; it then goes on to the next mark.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

#: Marks of a block and of a stream's end, and a stream's head (fixed values of the format).
BLOCK, END, HEAD = 0x314159265359, 0x177245385090, b"BZh9"
STEP = 1 << 20


def _patterns(mark: int) -> list[tuple[bytes, int]]:
    """For each bit at which a mark may begin in a byte: the five whole bytes behind that byte."""
    return [((mark >> shift & (1 << 40) - 1).to_bytes(5, "big"), shift) for shift in range(8)]


_SOUGHT = [(mark, inner, shift) for mark in (BLOCK, END) for inner, shift in _patterns(mark)]


def marks(file, start: int) -> Iterator[tuple[int, bool]]:
    """(bit, whether a block begins there) of the marks that begin at or after byte ``start``, in order."""
    at = start
    file.seek(at)
    data = file.read(STEP)
    while len(data) >= 6:
        found = []
        for mark, inner, shift in _SOUGHT:
            k = data.find(inner, 1)
            while k >= 0:
                size = 6 if shift == 0 else 7
                bits = int.from_bytes(data[k - 1 : k - 1 + size], "big")
                if k - 1 + size <= len(data) and bits >> (8 * size - 48 - shift) & (1 << 48) - 1 == mark:
                    found.append((8 * (at + k - 1) + shift, mark == BLOCK))
                k = data.find(inner, k + 1)
        done = len(data) - 6
        yield from sorted(m for m in found if m[0] < 8 * (at + done))
        at += done
        more = file.read(STEP)
        if not more:
            yield from sorted(m for m in found if m[0] >= 8 * at)
            return
        data = data[done:] + more


def _stream(file, start: int, end: int) -> bytes:
    """The bits from ``start`` to ``end`` as a stream of one block."""
    low, high = start // 8, -(-end // 8)
    file.seek(low)
    bits = int.from_bytes(file.read(high - low), "big") >> (8 * high - end) & (1 << (end - start)) - 1
    check = bits >> (end - start - 80) & (1 << 32) - 1
    size = end - start + 80
    whole = bits << 80 | END << 32 | check
    return HEAD + (whole << -size % 8).to_bytes(-(-size // 8), "big")


def blocks(file, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(bit, data) of the blocks that begin at or after byte ``start``."""
    opened: int | None = None
    seeker = marks(_Apart(file), start)
    for bit, begins in seeker:
        if opened is not None:
            try:
                data = bz2.decompress(_stream(file, opened, bit))
            except (OSError, ValueError):
                continue  # no mark, but bits of the block
            yield opened, data
            opened = None
        if begins:
            opened = bit
    if opened is not None:
        raise EOFError(f"the block at bit {opened} has no end")


class _Apart:
    """A reader of a file with a place of its own."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data


class Part:
    """What a range of compressed bytes decompresses to, and what follows: ``read`` as of a file, ``own`` bytes of it once they are known."""

    def __init__(self, file, start: int, end: int):
        self.blocks, self.end, self.given, self.own = blocks(file, start), 8 * end, 0, None

    def read(self, n: int) -> bytes:
        bit, data = next(self.blocks, (None, b""))
        if self.own is None and (bit is None or bit >= self.end):
            self.own = self.given
        self.given += len(data)
        return data if data or bit is None else self.read(n)
