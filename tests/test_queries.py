"""Queries of the corpus views at the smallest scale, each against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from citeloom import plans

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or pd.isna(x):
            return None
        if hasattr(x, "isoformat"):
            return str(x)[:10]
        return round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["v4_citation_checks", "v5_statute_checks", "v12_export_gate"])
def test_quoted_texts_that_read_as_citations(spark, name, tmp_path):
    """What a draft quotes is none of its citations, whatever it reads as; a draft that quotes no text is checked all the same."""
    texts = {6: "In 6276 Orenen halyat.\nAnre 37 te lonid 12 USC 7 at", 12: "Te sen arole the bolen ro cand" + "id. Elo banen", 18: None, 24: "", 30: "Te\0 sen arole", 42: 'Ro 7 U.S. 9, "id. supra § 3'}
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        table = f.removesuffix(".parquet")
        if table == "documents":
            rows_ = connection.execute(f"SELECT * FROM '{FOLDER}/{f}'").df()
            rows_["text"] = [texts.get(i, t) for i, t in zip(rows_["doc_id"], rows_["text"], strict=True)]
            rows_.to_parquet(str(tmp_path / f))
        else:
            os.symlink(f"{FOLDER}/{f}", tmp_path / f)
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{f}'")
    got = plans.queries()[name](spark, str(tmp_path)).toPandas()
    want = connection.execute(plans.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
