"""A splittable source of multi-line CSV records in the COPY dialect.

Records hold line feeds inside quotes and backslash escapes, so Spark's reader
can't split their files. A line that begins with a quoted number and a quoted
date begins a record: each partition is a byte range of a file, and a record belongs to the
range in which the byte before it lies. A range of a bz2 file has the blocks that begin
in it. Rows of the wrong width, or whose first field isn't the
number that their first line begins with, that can't be read or that have a
monstrous field, are rejects with their reason, not data.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .bz2_blocks import Part

BOUNDARY = rb'"(\d+)","\d{4}-'
DIALECT = {"doublequote": False, "escapechar": "\\", "quoting": csv.QUOTE_MINIMAL}
STEP = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    header: tuple[str, ...] | None = None


def opened(path: str):
    """File system and path of a local or remote location."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def lines(handle) -> Iterator[tuple[int, bytes]]:
    """Lines of what a handle reads, with their places in it."""
    kept = b""
    place = 0
    while block := handle.read(STEP):
        kept += block
        *whole, kept = kept.split(b"\n")
        for line in whole:
            yield place, line + b"\n"
            place += len(line) + 1
    if kept:
        yield place, kept


def fields_of(text: str) -> list[str]:
    return next(csv.reader(io.StringIO(text, newline=""), **DIALECT), [])


def records(source: Iterator[tuple[int, bytes]], past: Callable[[int], bool], boundary: re.Pattern) -> Iterator[tuple[list[str] | None, int, str | None]]:
    """Fields, leading number and error of each record of some lines, up to the first that begins where ``past`` says."""
    held: list[bytes] = []

    def parsed() -> tuple[list[str] | None, int, str | None]:
        lead = int(boundary.match(held[0])[1])
        try:
            return fields_of(b"".join(held).decode("utf-8", "replace")), lead, None
        except csv.Error as error:
            return None, lead, f"unreadable: {error}"

    for place, line in source:
        if boundary.match(line):
            if held:
                yield parsed()
                held = []
            if past(place):
                return
            held = [line]
        elif held:
            held.append(line)
    if held:
        yield parsed()


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names[:-1], options["path"]
        self.size = int(options.get("shardbytes", options.get("shardBytes", 64 << 20)))
        self.boundary = re.compile(options.get("boundary", BOUNDARY.decode()).encode())
        self.most = int(options.get("maxmisaligned", options.get("maxMisaligned", 50)))
        self.largest = int(options.get("maxfieldchars", options.get("maxFieldChars", 1 << 30)))
        self.by_name = str(options.get("header", "false")).lower() == "true"
        csv.field_size_limit(1 << 30)

    def _files(self) -> list[tuple[str, int]]:
        """Files with their sizes: one, or those of a folder."""
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type != pafs.FileType.Directory:
            return [(self.path, info.size)]
        inside = [f for f in files.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [(f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in inside]

    def _header(self, name: str, size: int) -> tuple[str, ...]:
        """Names in the first line of a file; an error if one that is asked for isn't there."""
        files, path = opened(name)
        with files.open_input_file(path) as raw:
            first = next(lines(Part(raw, 0, size) if name.endswith(".bz2") else raw), (0, b""))[1]
        header = tuple(fields_of(first.decode("utf-8", "replace")))
        if missing := [n for n in self.names if n not in header]:
            raise ValueError(f"{name} has no columns {missing}")
        return header

    def partitions(self) -> list[Range]:
        found = []
        for name, total in self._files():
            header = self._header(name, total) if self.by_name else None
            found += [Range(name, a, min(a + self.size, total), header) for a in range(0, total, self.size)]
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        files, path = opened(part.path)
        with files.open_input_file(path) as raw:
            if part.path.endswith(".bz2"):
                blocks = Part(raw, part.start, part.end)
                source, past = lines(blocks), lambda place: blocks.own is not None and place > blocks.own
                # A range without a block of its own, and one whose last byte before a record is another's, give nothing.
            else:
                raw.seek(part.start)
                source, past = lines(raw), lambda place: part.start + place > part.end
            if part.start > 0:  # the line that the range begins in belongs to the one before
                next(source, None)
            yield from self._rows(records(source, past, self.boundary), part)

    def _rows(self, found: Iterator[tuple[list[str] | None, int, str | None]], part: Range) -> Iterator[tuple]:
        width = len(part.header or self.names)
        places = [part.header.index(n) for n in self.names] if part.header else range(width)
        misaligned = 0
        for fields, lead, reason in found:
            aligned = bool(fields) and fields[0].isdigit() and int(fields[0]) == lead
            misaligned = 0 if aligned else misaligned + 1
            if misaligned > self.most:
                raise ValueError(f"{misaligned} records in a row don't begin with their number, before byte {part.end} of {part.path}")
            if reason is None and len(fields) != width:
                reason = f"width {len(fields)} instead of {width}"
            elif reason is None and not aligned:
                reason = "misaligned"
            elif reason is None and (size := max(map(len, fields))) > self.largest:
                reason = f"quarantined: a field of {size} characters"
            yield (*[None] * len(self.names), reason) if reason else (*(fields[k] for k in places), None)


class ShardedCsv(DataSource):
    """``format("sharded_csv")`` of a file or the files of a folder; all columns are strings, the last one says why a row is rejected.

    Options: ``columns``, by place, or by name with ``header``; ``shardBytes``, ``boundary``,
    ``maxMisaligned`` (records in a row that end the read), ``maxFieldChars`` (quarantine).
    """

    @classmethod
    def name(cls) -> str:
        return "sharded_csv"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in [*self.options["columns"].split(","), "_reject"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))
