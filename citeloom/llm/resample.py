"""Target-distribution importance resampling over hashed word n-grams, by external sort and count.

The first pass writes each document's buckets as packed 16-bit numbers, a row each, which
lie side by side in an Arrow batch. The second sorts and run-length encodes these streams,
a million buckets at once, for the corpus counts. With those of the target they give each bucket's gain,
and the third pass gathers gains along the streams and sums them between offsets. Draws
with replacement by chance become the highest of weight plus Gumbel noise, which a hash of
the id makes, so that the sample is the same on every run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, text_bytes, written

#: Words of lower-cased UTF-8: digits, letters a to z, and all characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Text bytes that are held as lists of words at once, and buckets that are counted or weighed at once.
PART_BYTES, STREAM = 4 << 20, 1 << 20


def _parts(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    start = 0
    while len(data) - start > PART_BYTES:
        tail = WORD.match(data, start + PART_BYTES)
        end = tail.end() if tail else start + PART_BYTES
        yield WORD.findall(data, start, end)
        start = end
    yield WORD.findall(data, start)


def buckets_of(text: str, buckets: int, longest: int = 3) -> tuple[np.ndarray, int]:
    """Buckets of all runs of one to ``longest`` words, and the number of words; a run's hash goes on from that of its head."""
    found: list[np.ndarray] = []
    n_words = 0
    tail: list[bytes] = []
    for words in _parts(text.encode().lower()):
        n_words += len(words)
        joined = [b" " + w for w in tail + words]
        hashes = list(map(crc32, tail + words))
        # Runs that end in this part: those of k words start k - 1 words before the end of the tail.
        found.append(np.array(hashes[len(tail) :], np.uint32))
        for k in range(1, longest):
            hashes = list(map(crc32, joined[k:], hashes))
            found.append(np.array(hashes[max(0, len(tail) - k) :], np.uint32))
        tail = (tail + words)[-(longest - 1) :] if longest > 1 else []
    return (np.concatenate(found) % buckets).astype(np.uint16), n_words


def _streams(buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            docs, words, held, size = [], [], [], 0
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                got, n = buckets_of(text.as_py() or "", buckets)
                docs.append(doc)
                words.append(n)
                held.append(got.astype("<u2", copy=False).tobytes())
                size += len(held[-1])
                if size > PART_BYTES:
                    yield from _held(docs, words, held)
                    docs, words, held, size = [], [], [], 0
            if docs:
                yield from _held(docs, words, held)

    return run


def _held(docs: list, words: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
    return batches([(pa.array(docs, pa.int64()), pa.array(words, pa.int64()), pa.array(held, pa.binary()))], ["doc_id", "n_words", "stream"])


def streams(docs: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``(doc_id, n_words, stream)``: the buckets of each document as little-endian 16-bit numbers.

    A row is no larger than its document, since a Parquet writer holds a hundred rows at least and
    a reader some thousands. In an Arrow batch they lie side by side all the same.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    return docs.select("doc_id", "text").mapInArrow(_streams(buckets), "doc_id long, n_words long, stream binary")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows of a batch, and where each row's begin and the last one's end."""
    raw, at = text_bytes(column)
    return raw.view("<u2"), at // 2


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a stream and how often each comes."""
    ordered = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for part in parts:
        got, _ = _packed(part.column(0))
        for i in range(0, len(got), STREAM):
            values, n = run_lengths(got[i : i + STREAM])
            total[values] += n
    some = np.flatnonzero(total)
    yield from batches([(pa.array(some, pa.int64()), pa.array(total[some]))], ["bucket", "n"])


def bucket_counts(written_streams: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets; ``buckets`` rows at most come to the driver."""
    counts = np.zeros(buckets, np.int64)
    rows = written_streams.select("stream").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much more frequent a bucket is in the target, each count one higher, floored."""
    k = len(corpus)
    up = (target + 1.0) * (float(corpus.sum()) + k)
    down = (corpus + 1.0) * (float(target.sum()) + k)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(gain: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            docs, words, stream = part.columns
            got, at = _packed(stream)
            n, begins = np.diff(at), at[:-1]
            weight = np.zeros(len(n), np.int64)
            own = np.flatnonzero(n)  # empty documents have no place of their own in the sums
            for i in range(0, len(got), STREAM):
                # Documents that a piece has any of: the one that holds its first bucket, and all that begin in it.
                some = own[np.searchsorted(begins[own], i, "right") - 1 : np.searchsorted(begins[own], i + STREAM)]
                weight[some] += np.add.reduceat(gain[got[i : i + STREAM]], np.maximum(begins[some] - i, 0))
            yield from batches([(docs, words, pa.array(n), pa.array(weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable from the first 32 bits of a hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in their order with the number of their sorted part and their place in it."""
    k, n = TaskContext.get().partitionId(), 0
    for part in parts:
        place = pa.array(np.arange(n, n + len(part)))
        n += len(part)
        yield from batches([(*part.columns, pa.array(np.full(len(part), k, np.int64)), place)], [*part.schema.names, "part", "place"])


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is 1, 2, 3... for those drawn, else null.

    ``docs`` and ``target`` have a ``text``, ``docs`` a ``doc_id``. Of the N documents of
    ``least_words`` words or more, ``floor(percent * N / 100)`` with the highest scores
    are drawn; of equal scores the smaller doc_id first, of equal ids (rows that repeat
    one) the smaller weight. A null text has no words. A row without an id has no score,
    isn't counted in N and is never drawn. An empty target has the same gain for
    all buckets that come equally often; an empty table gives an empty table. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    held = written(streams(docs, buckets), "buckets")
    aimed = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    gain = gains(bucket_counts(held, buckets), bucket_counts(aimed, buckets))
    weighed = held.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("able", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)).drop("n_words"), "scores")
    n = scored.where("able").count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight"), F.col("n_features")]
    able = scored.where("able").select("doc_id", "n_features", "weight", "score").orderBy(*order)
    placed = written(able.mapInArrow(_placed, "doc_id long, n_features long, weight long, score long, part long, place long"), "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part of the sort, so some thousands.
    base = placed.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place") + 1
    ranked = placed.join(F.broadcast(base), "part").withColumn("rank", F.when(rank <= n, rank))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(~F.col("able")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(names).unionByName(rest.select(names))
