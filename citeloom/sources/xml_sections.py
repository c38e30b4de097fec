"""Sections of statutes from XML feeds, plain or zipped; files are read by Spark as binary rows."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of the regulation feed that hold body text, and of the code feed (fixed values).
REGULATION_BODY = frozenset({"P", "FP", "PSPACE", "EXTRACT", "CITA", "HD", "HD1", "HD2"})
CODE_BODY = frozenset({"content", "P", "FP", "note", "text"})
SECTION_SCHEMA = "source string, section string, heading string, text string, effective_date string"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def document(content: bytes) -> bytes:
    """XML bytes; of a zip, those of its first member that is XML. Declarations of types or entities are refused."""
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
            if name is None:
                raise ValueError("the archive has no XML")
            content = z.read(name)
    head = content[:4096].lower()
    if b"<!doctype" in head or b"<!entity" in head:
        raise ValueError("XML with a document type or an entity")
    return content


def _bodies(e: ET.Element, names: frozenset[str], skip: ET.Element | None) -> Iterator[str]:
    """Texts of the highest elements that hold body text."""
    for child in e:
        if child is skip:
            continue
        if _name(child) in names:
            if t := _text(child):
                yield t
        else:
            yield from _bodies(child, names, None)


def regulation_sections(content: bytes) -> Iterator[tuple]:
    """Nodes of type SECTION with a number and a heading or a text."""
    for node in ET.fromstring(document(content)).iter():
        if node.get("TYPE") == "SECTION" and node.get("N"):
            head = next((c for c in node if _name(c) == "HEAD"), None)
            heading = _text(head)
            body = [t for c in node.iter() if _name(c) in REGULATION_BODY and (t := _text(c))]
            text = " ".join(body)
            if heading or text:
                yield "ecfr", node.get("N"), heading, text, None


def code_sections(content: bytes) -> Iterator[tuple]:
    """Elements ``section``, whatever their namespace, with a number and a heading or a text."""
    for node in ET.fromstring(document(content)).iter():
        if _name(node) != "section":
            continue
        part = {n: next((c for c in node if _name(c) == n), None) for n in ("num", "heading", "effective_date")}
        number = (part["num"].get("value") if part["num"] is not None else None) or node.get("identifier", "").removeprefix("sec_")
        heading, text = _text(part["heading"]), " ".join(_bodies(node, CODE_BODY, part["heading"]))
        if number and (heading or text):
            yield "usc", number, heading, text, _text(part["effective_date"]) or None


def sections(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """(path, source, section, heading, text, effective_date, error) of all files; ``feed``: regulation or code.

    A file that can't be read or is refused has one row with its ``error``; the others are read.
    """
    parse = {"regulation": regulation_sections, "code": code_sections}[feed]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[c.split()[0] for c in SECTION_SCHEMA.split(", ")], "error"]
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = [(file, *s, None) for s in parse(bytes(content))]
                except (ET.ParseError, ValueError, zipfile.BadZipFile) as error:
                    found = [(file, *[None] * (len(names) - 2), f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(found, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"path string, {SECTION_SCHEMA}, error string")


def upsert(known: DataFrame, fresh: DataFrame, key: list[str], order: str) -> DataFrame:
    """``known`` with the rows of ``fresh``, of which the one with the largest ``order`` wins on the key."""
    last = fresh.groupBy(*key).agg(F.max_by(F.struct(*fresh.columns), order).alias("row")).select("row.*")
    return known.join(last.select(*key), key, "left_anti").unionByName(last)


def copy_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small files of the COPY dialect by Spark's own reader (S1, S2): bz2 by extension, empty text kept apart from null."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, escape="\\", quote='"', emptyValue="", mode="PERMISSIVE")
    return reader.csv(path)


def rejects(rows: DataFrame) -> DataFrame:
    """Counts of rejected rows of a sharded source by reason."""
    return rows.where("_reject is not null").groupBy("_reject").agg(F.count("*").alias("n"))
