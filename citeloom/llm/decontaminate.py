"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification. Spark expressions only.

A document that holds ``share`` of an item's shingles holds at least one of any
``n - ceil(share * n) + 1`` of them. So the smallest hashes of each item, as many
as its size band needs, are a sketch that no such document misses, however long
it is. That holds for any of its shingles, so those that fewest items have come first,
and a shingle of all items hardly makes a candidate. Each band of item sizes has a bitmap
of its sketches, and a document is searched for those of the bands whose items it is large
enough to hold, if any sketch at all has a hash in common with it. Documents with a
hit keep all shingles that a bitmap of all items lets pass, as one array. Only pairs that
share a sketch hash are candidates, and each is one intersection of two arrays, so
that a shingle of many items and many documents isn't multiplied out. Bitmaps only spare
work: they never lose a hit.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, written
from .native_text import window_hashes, words

#: Bits of a bitmap for each hash, of which it sets two; and its 64-bit words at most: eight megabytes.
BITS = 256
WORDS = 1 << 20


def _shingles(text: Column, sizes: list[int]) -> Column:
    hashes = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        arrays = [window_hashes(h, n) for n in sizes]
        return F.array_distinct(F.concat(*arrays) if len(arrays) > 1 else arrays[0])

    return F.get(F.transform(F.array(hashes), windows), F.lit(0))


def _places(h: Column, words: int) -> list[tuple[Column, Column]]:
    """Word and bit of the two bits of a hash, in its lower and its upper half."""
    halves = (h, F.shiftrightunsigned(h, 32))
    return [(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(words - 1)).cast("int"), x.bitwiseAND(F.lit(63)).cast("int")) for x in halves]


def _bitmaps(hashes: DataFrame, most: int) -> tuple[dict[int | None, Column], int]:
    """For each ``band``, and for all as None, a bitmap of the hashes ``h``, as a constant, sized for ``most`` of them, and its words; WORDS rows a band come to the driver at most."""
    words = 1 << max(8, min(WORDS.bit_length() - 1, (most * BITS // 64).bit_length()))
    places = F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("bit")) for w, b in _places(F.col("h"), words)])
    set_ = hashes.select("band", F.explode(places).alias("x")).groupBy("band", "x.word").agg(F.bit_or("x.bit").alias("bits"))
    maps: dict[int | None, list[int]] = {}
    for row in set_.collect():
        for band in {row["band"], None}:
            maps.setdefault(band, [0] * words)[row["word"]] |= row["bits"]
    return {band: F.from_json(F.lit(json.dumps(bits)), "array<bigint>") for band, bits in maps.items()}, words


def _in(bitmap: Column, words: int, h: Column) -> Column:
    (w, b), (v, c) = _places(h, words)
    one = lambda word, bit: F.call_function("shiftright", F.get(bitmap, word), bit).bitwiseAND(F.lit(1)) == 1
    return one(w, b) & one(v, c)


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)`` of every document that holds ``share`` or more of an item's distinct shingles.

    Shingles are of ``size`` lower-cased words; an item with fewer words is one
    shingle of all of them, looked for among windows of that many. Items and
    documents without words match nothing. Rows that repeat a doc_id or an
    item_id count as one; null ids match nothing. Shingles are compared by
    64-bit hashes. Other columns are ignored.
    """
    up, down = share
    items = benchmark.where("item_id is not null").select("item_id", "text", F.size(words(F.col("text"))).alias("n_words")).where("n_words > 0")
    items = items.withColumn("width", F.least("n_words", F.lit(size)))
    sizes = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``size`` values
    if not sizes:
        return docs.limit(0).select("doc_id").withColumns({"item_id": F.lit(0).cast("long"), "n_shared": F.lit(0).cast("long"), "n_item": F.lit(0).cast("long")})
    pick = F.lit(None).cast("array<bigint>")
    for n in sizes:
        pick = F.when(F.col("width") == n, _shingles(F.col("text"), [n])).otherwise(pick)
    rows = items.select("item_id", F.explode(pick).alias("h")).distinct()
    counted = rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    # All items of a band (sizes from one power of two to the next) have sketches that its largest would need.
    counted = counted.withColumn("band", F.floor(F.log2("n_item") + 1e-9).cast("int"))
    need = F.floor((F.pow(F.lit(2), F.col("band") + 1) - 1) * (down - up) / down + 1e-9) + 1
    spread = rows.groupBy("h").agg(F.count("*").alias("items"))
    ranked = counted.join(spread, "h").withColumn("rank", F.expr("row_number() over (partition by item_id order by items, xxhash64(h), h)"))
    known = written(ranked.select("item_id", "h", "n_item", "band", (F.col("rank") <= need).alias("sketch")), "items")
    bands = known.groupBy("band").agg(F.count_if("sketch").alias("n"), F.count("*").alias("every")).collect()  # some dozen at most

    sketches, words_ = _bitmaps(known.where("sketch"), max(r["n"] for r in bands))
    full, wide = _bitmaps(known.withColumn("band", F.lit(0)), sum(r["every"] for r in bands))
    banded = [(band, bits) for band, bits in sketches.items() if band is not None]

    def hit(hs: Column) -> Column:
        """Whether a document's shingles hit a sketch; one pass over all bands' sketches spares most of them the search by band."""
        by_band = [(F.size(hs) * down >= (1 << band) * up) & F.exists(hs, lambda h: _in(bits, words_, h)) for band, bits in banded]
        return F.exists(hs, lambda h: _in(sketches[None], words_, h)) & reduce(or_, by_band)

    # Bound by a lambda, the shingles are made once; an outer explode keeps the optimizer from asking for them again.
    known_ones = F.transform(F.array(_shingles(F.col("text"), sizes)), lambda hs: F.when(hit(hs), F.filter(hs, lambda h: _in(full[None], wide, h))))
    found = docs.where("doc_id is not null").select("doc_id", F.explode_outer(F.array(F.get(known_ones, F.lit(0)))).alias("hs")).where("hs is not null")
    # What is left of the documents, those with a hit: read twice, so written.
    found = written(found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs")), "hits")
    sketch = known.where("sketch")
    sought = found.select("doc_id", F.explode("hs").alias("h")).join(sketch.select("h").distinct(), "h", "left_semi")
    n = sought.groupBy("h").agg(F.count("*").alias("n"))
    most = max(1000, (n.agg(F.sum("n")).first()[0] or 0) // 1000)
    pairs = join_by_key(sought, sketch.select("h", "item_id").join(n, "h"), ["h"], most).select("doc_id", "item_id").distinct()
    sets = known.groupBy("item_id").agg(F.collect_set("h").alias("own"), F.max("n_item").alias("n_item"))
    both = pairs.join(found, "doc_id").join(sets, "item_id")
    counted = both.select("doc_id", "item_id", F.size(F.array_intersect("hs", "own")).cast("long").alias("n_shared"), "n_item")
    return counted.where(F.col("n_shared") * down >= F.col("n_item") * up)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
