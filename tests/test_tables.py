"""Stages that are kept across applications."""

import os
import shutil
import subprocess
import sys
import time

import pytest

from citeloom.tables import Ledger, fingerprint

OTHER = """
import sys
from pyspark.sql import SparkSession
from citeloom.tables import Ledger
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
def make():
    raise RuntimeError("made again")
print("ROWS", sorted(tuple(r) for r in Ledger(spark, sys.argv[1]).stage("pair", [sys.argv[2]], {"least": 2}, make)["kept"].collect()))
"""


def test_ledger(spark, tmp_path):
    source, folder = str(tmp_path / "source"), f"file://{tmp_path}/ledger"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "ü")], "id long, x string").coalesce(1).write.parquet(source)
    ledger, made = Ledger(spark, folder), []

    def make(least=2, broken=False):
        def run():
            made.append(least)
            rows = spark.read.parquet(source)
            bad = rows.selectExpr("id", "raise_error('broken') AS x") if broken else rows.where(f"id < {least}")
            return {"kept": rows.where(f"id >= {least}"), "left": bad}

        return run

    # An attempt that breaks after its first table leaves no stage.
    with pytest.raises(Exception, match="broken"):
        ledger.stage("pair", [source], {"least": 2}, make(broken=True))
    assert ledger.committed(ledger.address("pair", [source], {"least": 2})) is None
    found = ledger.stage("pair", [source], {"least": 2}, make())
    assert sorted(tuple(r) for r in found["kept"].collect()) == [(2, "b"), (3, "ü")] and found["left"].count() == 1
    again = ledger.stage("pair", [source], {"least": 2}, make())
    assert made == [2, 2] and again["kept"].count() == 2 and again["kept"].schema == found["kept"].schema
    assert ledger.stage("pair", [source], {"least": 3}, make(3))["kept"].count() == 1 and made == [2, 2, 3]
    # Another application reads it.
    run = subprocess.run([sys.executable, "-c", OTHER, folder, source], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert "ROWS [(2, 'b'), (3, 'ü')]" in run.stdout, run.stderr[-2000:]
    # Tables that change make another stage.
    before = fingerprint(spark, source)
    time.sleep(1.1)
    shutil.rmtree(source)
    spark.createDataFrame([(5, "e")], "id long, x string").coalesce(1).write.parquet(source)
    assert fingerprint(spark, source) != before
    assert [tuple(r) for r in ledger.stage("pair", [source], {"least": 2}, make())["kept"].collect()] == [(5, "e")] and made == [2, 2, 3, 2]
