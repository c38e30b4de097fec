"""What several operators share: tables, the shared folder, text buffers and hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written  # noqa: F401  operators take it from here

#: Text bytes that one vectorised step handles; longer texts are steps of their own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def join_by_key(rows: DataFrame, known: DataFrame, on: list[str], most: int) -> DataFrame:
    """``rows`` with the columns that ``known`` has for their key; its ``n`` says how many rows each key has.

    Keys with more than ``most`` rows come by broadcast: with a thousandth of all
    rows or more as ``most`` there are few of them. All others come by a join in
    which no key has more, so that no key becomes one group in one task.
    """
    hot = F.broadcast(known.where(F.col("n") > most).drop("n").withColumn("hot", F.lit(True)))
    tagged = rows.join(hot, on, "left")
    rest = tagged.where("hot is null").select(rows.columns).join(known.where(F.col("n") <= most).drop("n"), on)
    return tagged.where("hot").drop("hot").unionByName(rest)


# ---------------------------------------------------------------- text buffers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole values with about ``most`` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def in_pieces(text: str, separator: str, size: int = 4_000_000) -> Iterator[str]:
    """``text`` cut before separators, so that a very long one never becomes one list of words."""
    start = 0
    while len(text) - start > size:
        cut = text.find(separator, start + size)
        while cut > 0 and text[cut - 1] == separator:  # a run of separators stays with what follows
            cut -= 1
        if cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


# ---------------------------------------------------------------------- hashes

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the base of the polynomial with its inverse modulo 2^64.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << int(n - 1).bit_length() if n > 1 else 2
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit hashes of any byte range of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all values: runs of bytes that are not ASCII white space."""
    space = SPACE[data]
    first = ~space
    inside = np.empty(len(data), bool)
    inside[:1] = False
    inside[1:] = ~space[:-1]
    starts_of = at[:-1][at[:-1] < len(data)]
    inside[starts_of] = False
    first &= ~inside
    start = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    ends_of = at[1:][at[1:] > 0] - 1
    last[ends_of] = ~space[ends_of]
    return start, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and, for each value, where its words start among them."""
    start, end = word_bounds(data, at)
    return Rolling(data)(start, end), np.searchsorted(start, at)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingle hashes of each value that has any.

    A-Z count as a-z. A value with fewer words than ``size`` has its whole
    sequence as one shingle; one without words has none and is left out.
    """
    raw, at = text_bytes(column)
    for i, j in steps(at):
        near = at[i : j + 1] - at[i]
        words, first = word_hashes(LOWER[raw[at[i] : at[j]]], near)
        if not len(words):
            continue
        grams = words[: max(0, len(words) - size + 1)].copy()
        for k in range(1, size):
            grams = mix(grams) + words[k : k + len(grams)]
        grams = mix(grams)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= size:
                yield i + d, np.unique(grams[a : b - size + 1])
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix(np.array([short], np.uint64))[0] ^ w
                yield i + d, mix(np.array([short], np.uint64))


def batches(rows: Iterable[tuple[pa.Array, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for arrays in rows:
        yield pa.RecordBatch.from_arrays(list(arrays), names)
