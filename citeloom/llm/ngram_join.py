"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

1. Every document becomes a sorted array of distinct shingle hashes. Documents
   with equal arrays form one class, represented by its smallest id.
2. Candidate families. Sizes fall into bands of ratio ``threshold``, so linked
   sets lie in one band or in neighbours. Per band the hash range is cut into
   segments, so many that of two linked sets at least one large segment is equal;
   the hash of a segment's content is a key, and each set gives keys for its own
   band and the one below. Sets that share keys, directly or through others, are a
   family. A frequent shingle alone makes no family, unlike with prefix filters.
3. Tiles. A family of moderate size is one tile; of larger ones, each pair of
   salted cells in equal or neighbouring bands is one. Inside a tile sets are
   sorted by size; parity bitmaps of hashed shingles bound the overlap of a pair
   from above, since differing bits need differing shingles. Tiles of bitmaps
   first cut families into close ones, whose sets, again in tiles, are then
   intersected exactly. Sets already linked, directly or not, are not compared
   again, so a tile gives links fewer than its sets.
4. Components of all links, with copies joined back to their class.

Results are exact but for two chances, below 1e-9 for a pair at the threshold: equal 64-bit hashes of
different shingles, and differences that by their hashes touch every large segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, join_by_key, mix, shingle_sets, written
from .components import HUB, components

#: Sets in a tile of sets or of bitmaps at most, on average, and shingles; larger families are cut into cells.
TILE_SETS = 1024
MAP_SETS = 1024
TILE_SHINGLES = 4_000_000
#: The chance, at most, that linked sets share no key.
MISS = 1e-9


class Bands:
    """Size bands, and into how many segments each cuts the hash range."""

    def __init__(self, threshold: float):
        if not 0.5 <= threshold < 1:
            raise ValueError("the threshold must be at least 0.5 and below 1")
        self.threshold, self._plans = threshold, {}

    def of(self, n: int) -> int:
        return int(math.log(n) / -math.log(self.threshold) + 1e-9)

    def plan(self, band: int) -> tuple[int, int]:
        """Segments of a band, and the fewest shingles of one that gives a key.

        Two linked sets differ in ``differ`` shingles at most, dealt to segments by
        hash. The fewest segments are taken with which the chance that no segment
        is equal in both and large enough is below MISS, for the largest such
        size; large segments are what unrelated texts don't share. Small sets get
        more segments than shingles that may differ (by eight deviations), or as
        many as part all shingles.
        """
        if band not in self._plans:
            low = max(1, math.ceil(self.threshold**-band - 1e-6))
            differ = math.floor((1 - self.threshold) / self.threshold * (self.threshold ** -(band + 1) + 1) + 1e-6)
            n = 1
            while n < 4 * low * low and n * (1 - math.exp(-low / n)) - 8 * math.sqrt(n * math.exp(-low / n)) < differ + 1:
                n += max(1, n // 50)
            self._plans[band] = (n, 1)
            for least in (4, 3, 2, 1):
                m = np.arange(8, max(9, low))
                mean = self.threshold * low / m
                small = sum(np.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
                missed = m * np.log1p(-np.exp(-differ / m) * (1 - small))
                if (missed < math.log(MISS)).any():
                    self._plans[band] = (int(m[np.argmax(missed < math.log(MISS))]), least)
                    break
        return self._plans[band]


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    one = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(one)).view(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles hash to each bit; four bits a shingle, 16,384 at most."""
    bits = 1 << min(14, max(6, int(4 * len(shingles) - 1).bit_length()))
    odd = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that the same shingles have with fewer bits."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _digests(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = np.zeros(len(part), np.int64)
            one, two = n.copy(), n.copy()
            maps: list[bytes | None] = [None] * len(part)
            for i, s in shingle_sets(part.column(1), size):
                n[i] = len(s)
                one[i], two[i] = set_digest(s)
                maps[i] = bitmap(s).tobytes()
            columns = (part.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(maps, pa.binary()))
            yield from batches([columns], ["doc_id", "n_shingles", "one", "two", "bits"])

    return run


def segment_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of one sorted set: for its own band and the one below."""
    own, out = bands.of(len(s)), []
    up = mix(s)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(up, dtype=np.uint64)])
    for band in {own, max(0, own - 1)}:
        m, least = bands.plan(band)
        which = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        ends = np.append(cut[1:], len(s))
        large = ends - cut >= least
        cut, ends = cut[large], ends[large]
        out.append(mix(mix(sums[ends] - sums[cut]) + which[cut] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    return np.concatenate(out)


def _keys(size: int, bands: Bands, flush: int = 1_500_000):
    """Rows (key, doc): one for each key of this task's flush, with its smallest document; rows (null, doc, other) link the rest to that."""

    def emit(keys: list[np.ndarray], docs: list[int], counts: list[int]) -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(keys), np.repeat(np.array(docs, np.int64), counts)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        low = doc[head][np.cumsum(head) - 1]
        links = np.unique(np.stack([doc[doc != low], low[doc != low]], 1), axis=0) if (doc != low).any() else np.zeros((0, 2), np.int64)
        n, k = len(links), int(head.sum())
        yield from batches(
            [(
                pa.concat_arrays([pa.array(key[head].view(np.int64)), pa.nulls(n, pa.int64())]),
                pa.array(np.concatenate([doc[head], links[:, 0]])),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(links[:, 1])]),
            )],
            ["key", "doc", "other"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, counts, held = [], [], [], 0
        for part in parts:
            ids = part.column(0).to_pylist()
            for i, s in shingle_sets(part.column(1), size):
                keys.append(segment_keys(s, bands))
                docs.append(ids[i])
                counts.append(len(keys[-1]))
                held += counts[-1]
                if held > flush:
                    yield from emit(keys, docs, counts)
                    keys, docs, counts, held = [], [], [], 0
        if docs:
            yield from emit(keys, docs, counts)

    return run


def _links_of_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: a link to the first document of the key. The key may run over several batches."""
    last_key, last_doc = None, None
    for part in parts:
        key, doc = part.column(0), part.column(1).to_numpy()
        given = np.flatnonzero(key.is_valid().to_numpy(zero_copy_only=False))
        a, b = [], []
        other = part.column(2)
        if len(given) < len(part):
            rest = np.flatnonzero(key.is_null().to_numpy(zero_copy_only=False))
            a.append(doc[rest])
            b.append(other.take(pa.array(rest)).to_numpy(zero_copy_only=False).astype(np.int64))
        if len(given):
            k, d = key.take(pa.array(given)).to_numpy(zero_copy_only=False).astype(np.int64), doc[given]
            head = np.concatenate([[k[0] != last_key], k[1:] != k[:-1]])
            low = np.concatenate([[0 if last_doc is None else last_doc], d[head]])[np.cumsum(head)]
            a.append(d[d != low])
            b.append(low[d != low])
            last_key, last_doc = int(k[-1]), int(low[-1])
        a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
        if len(a):
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            yield from batches([(pa.array(both[:, 0]), pa.array(both[:, 1]))], ["a", "b"])


def _sets(size: int):
    """Rows (text, tile, doc_id, side, one, two) to the sorted sets of those texts that have these digests."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            one, two = (part.column(c).to_numpy() for c in ("one", "two"))
            got = [(i, s) for i, s in shingle_sets(part.column(0), size) if set_digest(s) == (one[i], two[i])]
            rows = pa.array([i for i, _ in got], pa.int32())
            blob = pa.array([s.tobytes() for _, s in got], pa.binary())
            n = pa.array([len(s) for _, s in got], pa.int64())
            yield from batches([(*(part.column(c).take(rows) for c in ("tile", "doc_id", "side")), n, blob)], ["tile", "doc_id", "side", "n_shingles", "data"])

    return run


def tile_links(ids: np.ndarray, n: np.ndarray, maps: list[np.ndarray], side: np.ndarray, threshold: tuple[int, int], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links of one tile that join its sets into their components; of two cells, only pairs across them.

    ``n``: sizes; ``maps``: bitmaps, which bound each overlap from above; ``side``:
    the cell of each set, all equal if pairs inside count. Without ``sets``, pairs
    that the bound allows are links; with them, those whose exact overlap does.
    ``threshold``: as a fraction. Sets already in one component aren't compared.
    """
    up, down = threshold
    order = np.argsort(n, kind="stable")
    ids, n, side = ids[order], n[order], side[order]
    words = min(len(m) for m in maps)
    bits = np.stack([folded(maps[k], words) for k in order])
    inside = (side == side[0]).all()
    first = max(1, words // 8)  # an eighth of the bits rejects most pairs
    root = np.arange(len(ids))
    links = []
    tops = np.searchsorted(n, n * down // up, "right")
    for i in range(len(ids)):
        near = np.arange(i + 1, tops[i])
        near = near[root[near] != root[i]]
        if not inside:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        total = n[near] + n[i]
        # down * overlap >= up * (total - overlap) and overlap <= (total - differing) / 2
        most = total - 2 * -(-(up * total) // (up + down))
        for width in (first, words):
            differ = np.bitwise_count(bits[near, :width] ^ bits[i, :width]).sum(axis=1, dtype=np.int64)
            keep = differ <= most
            near, most = near[keep], most[keep]
        for j in near:
            if root[j] == root[i]:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if down * both < up * (int(n[i] + n[j]) - both):
                    continue
            links.append((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
            root[root == root[j]] = root[i]
    return links


def _tiles(threshold: tuple[int, int], exact: bool):
    """Rows (tile, doc_id, side, n_shingles, data) sorted by tile; one tile is held at a time. ``data``: shingles if exact, else bitmaps."""

    def links(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            ids, side, n = (np.array([h[k] for h in held], np.int64) for k in range(3))
            data = [np.frombuffer(h[3], np.uint64) for h in held]
            found = tile_links(ids, n, [bitmap(s) for s in data] if exact else data, side, threshold, data if exact else None)
            if found:
                a, b = zip(*found, strict=True)
                yield from batches([(pa.array(a, pa.int64()), pa.array(b, pa.int64()))], ["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None
        for part in parts:
            for tile, *row in zip(*(part.column(c).to_pylist() for c in ("tile", "doc_id", "side", "n_shingles", "data")), strict=True):
                if tile != name:
                    yield from links(held)
                    held, name = [], tile
                if not held or held[-1] != tuple(row):  # repeated rows count once
                    held.append(tuple(row))
        yield from links(held)

    return run


def _tiled(families: DataFrame, most_sets: int, most_load: int) -> DataFrame:
    """(doc_id, one, two, tile, side) of families (doc_id, component_id, n_shingles, one, two, band): a set goes to every tile where it must be compared."""
    key = ("doc_id", "one", "two")
    bands = families.groupBy("component_id", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    salts = F.ceil(F.greatest(F.lit(1), 2 * F.col("n") / most_sets, 2 * F.col("load") / most_load)).cast("int")
    by_band = Window.partitionBy("component_id").orderBy("band")  # some dozen bands a family
    near = lambda column, step: F.when(column(F.col("band")).over(by_band) == F.col("band") + step, column(F.col("salts")).over(by_band))
    family = Window.partitionBy("component_id")
    cells = (
        bands.withColumn("salts", salts)
        .withColumns({"salts_below": near(F.lag, -1), "salts_above": near(F.lead, 1)})
        .withColumns({"sets": F.sum("n").over(family), "all": F.sum("load").over(family)})
        .where("sets > 1")
        .withColumn("small", F.expr(f"sets <= {most_sets} and all <= {most_load}"))
        .drop("load", "sets", "all")
    )
    known = join_by_key(families, cells, ["component_id", "band"], max(HUB, families.count() // 1000))
    small = known.where("small").select(*key, F.col("component_id").cast("string").alias("tile"), F.lit(0).alias("side"))
    large = known.where("not small").withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, one), salts) as int)"))
    # A set goes to the tile of its cell with each other cell of its band, of the band below and of the band above.
    pairs = F.expr(
        """concat(
          transform(sequence(0, salts - 1), s -> named_struct('tile', concat_ws(':', component_id, band, least(s, salt), greatest(s, salt)), 'side', salt)),
          if(salts_below is null, array(), transform(sequence(0, salts_below - 1), s -> named_struct('tile', concat_ws(':', component_id, band - 1, 'up', s, salt), 'side', -1))),
          if(salts_above is null, array(), transform(sequence(0, salts_above - 1), s -> named_struct('tile', concat_ws(':', component_id, band, 'up', salt, s), 'side', 1))))"""
    )
    return small.unionByName(large.select(*key, F.explode(pairs).alias("x")).select(*key, "x.tile", "x.side"))


def jaccard_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document.

    Documents link when ``down * overlap >= up * union`` for ``threshold = (up, down)``,
    over the sets of distinct ``size``-word shingles; A-Z count as a-z, words are
    separated by ASCII white space. Null and empty texts have no shingles and are
    linked with nothing. Rows that repeat a doc_id are one document of several
    texts: each row has its own ``n_shingles``, each text its links, and all of them
    one component. Null ids keep a row each with a null component. Other columns
    are ignored.
    """
    up, down = threshold
    bands = Bands(up / down)
    texts = docs.select("doc_id", "text")
    found = written(
        texts.mapInArrow(_digests(size), "doc_id long, n_shingles long, one long, two long, bits binary"), "digests"
    )
    filled = found.where("n_shingles > 0 and doc_id is not null")
    # One row stands for all with an equal set: its class, under the smallest doc_id. Ids that repeat with other texts have several.
    step = -math.log(up / down)
    heads = written(
        filled.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("doc_id"))
        .withColumn("band", F.floor(F.ln("n_shingles") / F.lit(step) + 1e-9).cast("int")),
        "classes",
    )
    copies = filled.join(heads.withColumnRenamed("doc_id", "class_id"), ["n_shingles", "one", "two"]).where("doc_id <> class_id")

    keys = texts.where("doc_id is not null").mapInArrow(_keys(size, bands), "key long, doc long, other long")
    shared = written(
        keys.repartition(F.coalesce("key", F.xxhash64("doc", "other")))
        .sortWithinPartitions("key", "doc")
        .mapInArrow(_links_of_keys, "a long, b long"),
        "family-links",
    )
    families = written(components(shared).withColumnRenamed("id", "doc_id").join(heads, "doc_id"), "families")
    cells = _tiled(families, MAP_SETS, 4 * TILE_SHINGLES)
    bounded = written(
        filled.select("doc_id", "n_shingles", "one", "two", F.col("bits").alias("data"))
        .join(cells, ["doc_id", "one", "two"])
        .select("tile", "doc_id", "side", "n_shingles", "data")
        .repartition("tile")
        .sortWithinPartitions("tile", "doc_id", "data")
        .mapInArrow(_tiles(threshold, False), "a long, b long"),
        "bounded",
    )
    close = written(components(bounded).withColumnRenamed("id", "doc_id").join(heads, "doc_id"), "close")
    rows = texts.join(_tiled(close, TILE_SETS, TILE_SHINGLES).hint("merge"), "doc_id").select("text", "tile", "doc_id", "side", "one", "two")
    links = written(
        rows.mapInArrow(_sets(size), "tile string, doc_id long, side int, n_shingles long, data binary")
        .repartition("tile")
        .sortWithinPartitions("tile", "doc_id", "data")
        .mapInArrow(_tiles(threshold, True), "a long, b long"),
        "links",
    )
    joined = components(links.union(copies.select("doc_id", "class_id")))
    return found.join(joined, found.doc_id == joined.id, "left").select(
        found.doc_id,
        "n_shingles",
        F.coalesce("component_id", found.doc_id).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` without those that link, directly or not, to one with a smaller id; rows without an id stay."""
    gone = jaccard_components(docs, size, threshold).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
