"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers split the same bytes. For each byte stands the token that owns it, under
A and under B; where a pair of owners differs from the one before, an overlap begins, and
where both owners change at once the text is cut into groups. The last pair of owners
of a group ends together and is a link. How often an id pair is linked in the corpus is
counted over blocks of many documents: each block keeps its distinct pairs and,
for each link, the place of its pair among them; counts go back to the blocks, so that
a frequent pair meets the counts once a block. Rows are documents, or some pairs of a
block, so that none is larger than its document whatever a block holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import between_words, byte_bpe
from .common import batches, join_by_key, text_bytes, written

MARK = "▁"
#: Text characters whose owners are found together, and links of a block.
STEP_CHARS, BLOCK_LINKS = 500_000, 2_000_000


class PieceBpe:
    """Ids of a sentence-piece BPE model and the bytes that each stands for."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(k) for k in range(len(self.sp))]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.sp.is_byte(k) else b"" if self.sp.is_control(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)
        ]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this vocabulary has pieces over the ends of words")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def owner_changes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both owners, and where either one, changes at the next byte, the last byte of all included."""
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    return np.append(new_a & new_b, True), np.append(new_a | new_b, True)


class Aligned:
    """Tokens, overlaps, cuts and groups of some texts with one number of bytes under A and B; tokens are numbered through."""

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a_ids, self.b_ids = a_ids, b_ids
        owner_a = np.repeat(np.arange(len(a_ids)), a_size)
        owner_b = np.repeat(np.arange(len(b_ids)), b_size)
        both, either = owner_changes(owner_a, owner_b) if len(owner_a) else (np.zeros(0, bool), np.zeros(0, bool))
        #: Token numbers that share bytes, in order; those that end together; bytes after which both end.
        self.overlaps = np.stack([owner_a[either], owner_b[either]])
        self.links = np.stack([owner_a[both], owner_b[both]])
        self.cuts = np.flatnonzero(both) + 1

    def group_bytes(self, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids of both sides, with separators, in the order of groups; and where each group ends among them."""
        a_comma, a_bar, b_comma, b_end = tables
        last_a, last_b = self.links
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        # A's tokens of a group come after B's of the groups before, B's after A's of their own.
        b_before = np.append(0, last_b[:-1] + 1) if len(last_b) else last_b
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(n_a + n_b, object)
        ends_a, ends_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        ends_a[last_a], ends_b[last_b] = True, True
        out[np.arange(n_a) + np.repeat(b_before, size_a)] = np.where(ends_a, a_bar[self.a_ids], a_comma[self.a_ids])
        out[np.arange(n_b) + np.repeat(last_a + 1, size_b)] = np.where(ends_b, b_end[self.b_ids], b_comma[self.b_ids])
        return out, last_a + last_b + 2


class Aligner:
    def __init__(self, tokenizer: str, model: str):
        self.a, self.b = byte_bpe(tokenizer, special=False), PieceBpe(model)
        self.a_size = np.array([len(x) for x in self.a.bytes_of])
        self.b_size = np.array([len(x) for x in self.b.bytes_of])
        self.tables = [
            np.array([str(k).encode() + end for k in range(n)], object)
            for n, end in ((len(self.a_size), b","), (len(self.a_size), b"|"), (len(self.b_size), b","), (len(self.b_size), b";"))
        ]

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int], list[np.ndarray], list[np.ndarray]]:
        """Pieces of the texts with the text of each, and their ids under A and B; none of a text that B doesn't give back."""
        cut = [(k, j, p) for k, t in enumerate(texts) if t for j, p in enumerate(between_words(t))]
        # B puts a blank before what it is given; later pieces begin with theirs.
        b_ids = self.b.encode([p[1:] if j else p for _, j, p in cut])
        whole = [p if j else " " + p for _, j, p in cut]
        wrong = {k for (k, _, _), p, ids in zip(cut, whole, b_ids, strict=True) if b"".join([self.b.bytes_of[i] for i in ids]) != p.encode()}
        use = [i for i, (k, _, _) in enumerate(cut) if k not in wrong]
        return (
            [whole[i] for i in use], [cut[i][0] for i in use],
            [self.a.ids(whole[i]) for i in use], [np.array(b_ids[i], np.uint32) for i in use],
        )

    def align(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> Aligned:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (a_ids, b_ids))
        return Aligned(a, b, self.a_size[a], self.b_size[b])


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(tokenizer: str, model: str) -> Aligner:
    if (tokenizer, model) not in _aligners:
        _aligners[tokenizer, model] = Aligner(tokenizer, model)
    return _aligners[tokenizer, model]


def _some(texts: Iterator[str], most: int) -> Iterator[list[str]]:
    """Lists of texts of about ``most`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n > most:
            yield held
            held, n = [], 0
    if held:
        yield held


def alignments(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, overlaps, cuts)`` of every row: ids, pairs of token places that share bytes, and byte offsets where both end.

    Offsets count in a blank and the text. Null and empty texts, and those that B's pieces
    don't give back, have empty lists.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizer, model)
        names = ["doc_id", "a_ids", "b_ids", "overlaps", "cuts"]
        for part in parts:
            for k, text in enumerate(part.column(1)):
                _, _, a_ids, b_ids = aligner.pieces([text.as_py() or ""])
                got = aligner.align(a_ids, b_ids)
                pairs = pa.array([[{"a": a, "b": b} for a, b in got.overlaps.T.tolist()]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (got.a_ids, got.b_ids)]
                yield from batches([(part.column(0).slice(k, 1), *lists, pairs, pa.array([got.cuts.astype(np.int64)], pa.list_(pa.int64())))], names)

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a: int, b: int>>, cuts array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places"]
_BLOCK = pa.schema([
    ("block", pa.int64()), *[(n, pa.int64()) for n in _DOC[:4]], ("groups_sha256", pa.string()), ("places", pa.binary()),
    ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())),
])
#: Pairs of a row, and bytes of places in a batch: a Parquet writer holds a hundred rows at least, a reader's batch some thousands.
ROW_PAIRS, BATCH_BYTES = 512, 4 << 20


class _Block:
    """Documents of one block with their links."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.links: list[np.ndarray] = []
        self.at = [0]

    def add(self, doc: int | None, n_a: int, n_b: int, digest: str, links: list[np.ndarray]) -> None:
        n = sum(map(len, links))
        self.docs.append((doc, n_a, n_b, n, digest))
        self.links += links
        self.at.append(self.at[-1] + n)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Rows of a part of the block's distinct pairs each, in order, with how often it has them; and a row for each document with the places of its links' pairs among them."""
        pairs, places, ns = np.unique(np.concatenate([*self.links, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        self.links, places = [], places.astype("<u4")
        firsts = np.arange(0, len(pairs), ROW_PAIRS, dtype=np.int32)
        if len(firsts):
            lists = [pa.ListArray.from_arrays(pa.array(np.append(firsts, len(pairs)), pa.int32()), pa.array(x)) for x in (pairs, ns)]
            yield self._batch(len(firsts), {"block": [block] * len(firsts), "first": firsts, "pairs": lists[0], "ns": lists[1]})
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + BATCH_BYTES // 4, "right")) - 1)
            own = [places[a:b].tobytes() for a, b in zip(self.at[i:j], self.at[i + 1 : j + 1])]
            yield self._batch(j - i, {"block": [block] * (j - i), **dict(zip(_DOC, (*zip(*self.docs[i:j]), own)))})
            i = j

    @staticmethod
    def _batch(n: int, cells: dict) -> pa.RecordBatch:
        columns = [cells.get(f.name, [None] * n) for f in _BLOCK]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


def _blocks(tokenizer: str, model: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizer, model)
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for part in parts:
            docs = iter(part.column(0).to_pylist())
            for texts in _some((t.as_py() or "" for t in part.column(1)), STEP_CHARS):
                for found, doc in zip(_described(aligner, texts), docs):  # ends with found, before it takes from docs
                    block.add(doc, *found)
                    if block.at[-1] > BLOCK_LINKS:
                        yield from block.rows(number)
                        block, number = _Block(), number + 1
        if block.docs:
            yield from block.rows(number)

    return run


def _described(aligner: Aligner, texts: list[str]) -> list[tuple[int, int, str, list[np.ndarray]]]:
    """Tokens under A and B, digest of the groups and id pairs of the links of each text."""
    n_a, n_b = [0] * len(texts), [0] * len(texts)
    digests: list = [None] * len(texts)
    links: list[list[np.ndarray]] = [[] for _ in texts]
    pieces, of, a_ids, b_ids = aligner.pieces(texts)
    i = 0
    while i < len(pieces):
        j, chars = i, 0
        while j < len(pieces) and (j == i or chars + len(pieces[j]) <= 2 * STEP_CHARS):
            chars += len(pieces[j])
            j += 1
        got = aligner.align(a_ids[i:j], b_ids[i:j])
        out, ends = got.group_bytes(aligner.tables)
        codes = got.a_ids[got.links[0]].astype(np.int64) << 32 | got.b_ids[got.links[1]]
        groups_to = np.searchsorted(got.links[0], np.cumsum([len(x) for x in a_ids[i:j]]) - 1) + 1
        before = 0
        for k, to in zip(range(i, j), groups_to.tolist(), strict=True):
            doc = of[k]
            if digests[doc] is None:
                digests[doc] = hashlib.sha256()
            else:
                digests[doc].update(b";")
            first = ends[before - 1] if before else 0
            digests[doc].update(b"".join(out[first : ends[to - 1]].tolist())[:-1])
            links[doc].append(codes[before:to])
            n_a[doc] += len(a_ids[k])
            n_b[doc] += len(b_ids[k])
            before = to
        i = j
    return [(a, b, d.hexdigest() if d else "", x) for a, b, d, x in zip(n_a, n_b, digests, links, strict=True)]


def _returned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents (key, place, count, best, doc); before those of a block stand its pairs by place with their counts, if it has any."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    block, held, known = None, [], None
    for part in parts:
        key = part.column(0).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if key[i] >> 1 != block:
                block, held, known = key[i] >> 1, [], None
            some = part.slice(i, j - i)
            if not key[i] & 1:
                held.append([some.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)])
                continue
            if known is None:
                place, *found = (np.concatenate(x) for x in zip(*held)) if held else np.zeros((3, 0), np.int64)
                known, held = np.zeros((2, len(place)), np.int64), []
                known[:, place] = found
            doc = dict(zip(_DOC, some.column(4).flatten()))
            raw, at = text_bytes(doc["places"])
            places, n = raw.view("<u4"), np.diff(at) // 4
            sums = np.zeros((2, len(n)), np.int64)
            if len(places):
                sums[:, n > 0] = np.add.reduceat(known[:, places], at[:-1][n > 0] // 4, axis=1)
            columns = (doc["doc_id"], doc["n_a"], doc["n_b"], doc["n_groups"], doc["n_groups"], pa.array(sums[1]), pa.array(sums[0]), doc["groups_sha256"])
            yield from batches([columns], names)


def alignment_counts(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """Counts of each row's alignment and how often its linked id pairs are linked in the whole corpus.

    ``tokenizer`` is a byte-level BPE file (A), which encodes a blank and the text;
    ``model`` a sentence-piece BPE model (B), which puts the blank itself. Control strings
    inside texts are ordinary text. ``n_groups``: groups between offsets where tokens of
    both end; ``n_links``: token pairs that end together, so one a group;
    ``n_best``: links whose pair is as frequent as any of its B id; ``count_sum``: the
    sum of the pairs' corpus counts; ``groups_sha256``: hash of the groups' ids. Null and
    empty texts, and those that B's pieces don't give back (they hold B's own word mark,
    say), have zeros and an empty hash. Rows that repeat a doc_id or lack one are
    documents like all others, and their links count; an empty table gives an empty table. Other
    columns are ignored.
    """
    kinds = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, places binary, first int, pairs array<long>, ns array<long>"
    blocks = written(docs.select("doc_id", "text").mapInArrow(_blocks(tokenizer, model), kinds), "blocks")
    some = blocks.where("first is not null")
    rows = some.select("block", F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.ns").alias("m"))
    counts = rows.groupBy("pair").agg(F.sum("m").alias("count"), F.count("*").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = written(counts, "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # no more rows than B's vocabulary
    known = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"), "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = some.select("block", "first", F.posexplode("pairs").alias("place", "pair")).select("block", (F.col("first") + F.col("place")).alias("place"), "pair")
    back = join_by_key(placed, known, ["pair"], max(1000, total // 1000))
    # Pairs of a block pass before its documents, sorted by one number, so that no list of them is made.
    found = back.select((F.col("block") * 2).alias("key"), "place", "count", "best")
    own = blocks.where("first is null").select((F.col("block") * 2 + 1).alias("key"), F.struct(*_DOC).alias("doc"))
    dealt = found.unionByName(own, allowMissingColumns=True).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return dealt.mapInArrow(_returned, schema)
