"""Numbered queries at the smallest scale against their SQL; held-out accuracy of language ID."""

import os

import duckdb
import pandas as pd
import pytest

from citeloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else int(x) if hasattr(x, "dtype") or isinstance(x, int) else x for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_language_held_out(spark):
    got = queries.op5_language_id(spark, FOLDER).where("held_out").toPandas()
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(known, on="doc_id")
    assert len(both) > 20 and (both.lang == both.lang_pred).mean() > 0.97


def test_token_counts_on_a_table(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op9_token_counts(spark, FOLDER).collect()}
    for k, t in texts.items():
        n = len(sp.encode(t))
        assert got[k] == (k, len(t.encode()), n, n > 4096)
    assert len(got) == len(texts)


def test_packing_on_a_table(spark):
    """Every id of every document in one piece, as the library makes them; sequences full and gapless."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    pieces, sequences = {}, {}
    for r in queries.op7_packing(spark, FOLDER).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for k, own in pieces.items():
        ids = whole.encode(texts[k], add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)
    short = 0
    for rows_ in sequences.values():
        rows_.sort()
        assert rows_[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows_, rows_[1:])) and sum(rows_[-1]) <= 4096
        short += sum(rows_[-1]) < 4096
    assert short <= 1
