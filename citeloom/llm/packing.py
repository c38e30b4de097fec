"""Packing by concatenating and cutting: prefix sums over partition totals give global offsets.

The first pass turns every text into ids and keeps, with each document, the
tokens before it in its partition. The sums of the partitions' totals then give
each partition's first global offset; the second pass cuts documents where a
window of ``size`` tokens ends. A document over such a boundary has a record for
each window that it touches. No row moves between partitions.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, in_pieces, written

#: White space that the tokenizer drops and that no token spans.
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Characters whose lower case and normal form are their own affair: up to Latin Extended-A, but for controls and U+0130.
LATIN = [chr(c) for c in range(0x180) if c != 0x130 and (unicodedata.category(chr(c)) != "Cc" or chr(c) in " \t\n\r\x0b\x0c")]


def _class(*kinds: str) -> str:
    return "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] in kinds and not c.isspace())


ODD = re.compile(f"[^{''.join(map(re.escape, LATIN))}]")
#: Pre-tokens of lower-cased text of such characters.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[{_class('M', 'P', 'S', 'C')}]+")


class Codes(dict):
    """Numbers for pre-tokens and chunks, in the order in which they first come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class ChunkIds:
    """Ids of texts under a word-end BPE tokenizer; those of pre-tokens are kept for a while.

    Texts of plain Latin characters without special strings are lower-cased and
    split here, and only merged by the library; in others, each chunk between
    white space goes through the library's whole course.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.whole.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = tuple(t.content[:2] for t in self.whole.get_added_tokens_decoder().values())
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.ids = np.zeros(0, self.kind)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, text: str) -> bool:
        return not ODD.search(text) and not any(s in text for s in self.special)

    def learn(self) -> None:
        """Ids of the codes that are new."""
        keys, self.codes.new = self.codes.new, []
        if not keys:
            return
        plain = np.array([self.plain(k) for k in keys])
        size = np.zeros(len(keys), np.int64)
        ids: list[np.ndarray] = []
        if plain.any():
            pieces = [PIECE.findall(k.lower()) for k, p in zip(keys, plain, strict=True) if p]
            got = np.array(self.merger.encode_batch_fast([" ".join([p for ps in pieces for p in ps])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[got]) + 1
            last = np.cumsum([len(ps) for ps in pieces])
            size[plain] = np.diff(np.append(0, ends)[last], prepend=0)
            ids.append(got)
        if not plain.all():
            got = [e.ids for e in self.whole.encode_batch_fast([k for k, p in zip(keys, plain, strict=True) if not p], add_special_tokens=False)]
            size[~plain] = [len(g) for g in got]
            ids.append(np.array([k for g in got for k in g], np.int64))
        order = np.argsort(~plain, kind="stable")
        first = np.zeros(len(keys), np.int64)
        first[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate([self.ids, *(x.astype(self.kind) for x in ids)])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def coded(self, text: str) -> np.ndarray:
        keys = PIECE.findall(text.lower()) if self.plain(text) else CHUNK.findall(text)
        return np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))

    def gathered(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, self.kind)
        first, size = self.first[codes], self.size[codes]
        ends = np.cumsum(size)
        return self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1])]

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the library is quicker on what many texts need at once."""
        if len(self.codes) > self.most:
            self.clear()
        if len(texts) > 1 and max(map(len, texts)) > 4_000_000:  # a very long text goes alone
            return [ids for t in texts for ids in self.of_texts([t])]
        if len(texts) == 1 and len(cut := list(in_pieces(texts[0], " "))) > 1:
            return [np.concatenate([self.of_texts([p])[0] for p in cut])]
        found = [self.coded(t) for t in texts]
        self.learn()
        return [self.gathered(c) for c in found]


_ids: dict[str, ChunkIds] = {}


def _tokenise(path: str, end_id: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ids:
            _ids[path] = ChunkIds(path)
        ids = _ids[path]
        part_id, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], ids.kind)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            for i in range(0, len(texts), 512):
                some = texts[i : i + 512]
                got = [np.concatenate([g, end]) for g in ids.of_texts(some)]
                n = np.array([len(g) for g in got], np.int64)
                columns = (
                    pa.array(np.full(len(some), part_id, np.int64)), part.column(0).slice(i, len(some)), pa.array(before + np.cumsum(n) - n),
                    pa.array(n), pa.array([g.tobytes() for g in got], pa.binary()), pa.array(np.full(len(some), ids.kind().itemsize, np.int32)),
                )
                before += int(n.sum())
                yield from batches([columns], ["part", "doc_id", "before", "n", "ids", "width"])

    return run


def _cut(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for doc, at, n, blob, width in zip(*(part.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids", "width")), strict=True):
                ids = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, size)
                    length = min(size - offset, n - start)
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset))
                    start += length
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield from batches([tuple(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents.

    A document is its text's ids under the ``tokenizer`` file, then ``end_id``;
    null texts are empty, so that every row has one id at least. Every id lies in
    one piece; sequences are full but for the last. Rows that repeat a doc_id or
    lack one are documents like all others. Other columns are ignored.
    """
    done = written(
        docs.select("doc_id", "text").mapInArrow(
            _tokenise(tokenizer, end_id), "part long, doc_id long, before long, n long, ids binary, width int"
        ),
        "ids",
    )
    totals = done.groupBy("part").agg(F.sum("n").alias("total"))
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(totals.select("part", F.coalesce(F.sum("total").over(sums), F.lit(0)).alias("base")), "bases")
    if base.count() <= 1_000_000:  # a row for each task of the first pass
        base = F.broadcast(base)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return (
        done.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids", "width").mapInArrow(_cut(size), schema)
    )
