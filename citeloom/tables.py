"""Tables in the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode, as in tests, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the paths, sizes and times of change of all files below some paths; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    one = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum")).first()
    return hashlib.sha256(f"{one['n']} {one['sum']}".encode()).hexdigest()[:32]


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[], object]):
    """What ``make`` gives, made once in an application for each key: what others reuse. A key of what tables hold names their fingerprint."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


class Ledger:
    """Stages that are kept across applications in a folder, each committed by a marker.

    A stage is addressed by its name, its parameters and the fingerprint of its inputs. Its
    tables are written into a folder of the attempt; only then a marker names that
    folder, so that they come together or not at all, on object stores too, and an
    attempt that broke is never read. When parameters or inputs change, the address does. Of two
    applications that make a stage at once the later marker counts; both are right.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def address(self, name: str, inputs: list[str], parameters: dict) -> str:
        told = json.dumps({"inputs": fingerprint(self.spark, *inputs) if inputs else "", "parameters": parameters}, sort_keys=True)
        return f"{name}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def _marker(self, address: str):
        return self.path(f"{self.folder}/{address}.json")

    def committed(self, address: str) -> dict | None:
        """What a stage's marker says, or None."""
        if not self.files.exists(self._marker(address)):
            return None
        stream = self.files.open(self._marker(address))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, name: str, inputs: list[str], parameters: dict, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a stage, read where it is committed, else made and committed."""
        address = self.address(name, inputs, parameters)
        known = self.committed(address)
        if known is None:
            attempt = f"{address}-{uuid.uuid4().hex}"
            tables = make()
            for table, rows in tables.items():
                rows.write.parquet(f"{self.folder}/{attempt}/{table}")
            known = {"attempt": attempt, "schemas": {table: rows.schema.json() for table, rows in tables.items()}}
            out = self.files.create(self._marker(address), True)
            try:
                out.writeBytes(json.dumps(known))  # escapes all that isn't ASCII
            finally:
                out.close()
        read = {t: StructType.fromJson(json.loads(schema)) for t, schema in known["schemas"].items()}
        return {t: self.spark.read.schema(schema).parquet(f"{self.folder}/{known['attempt']}/{t}") for t, schema in read.items()}


#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders ``by`` a column: cuts lineage and survives lost executors.

    What the write shuffled goes at its end, since only the table is read from then
    on. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans it
        pass
