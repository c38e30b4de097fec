"""Small sources and sinks: dictionaries, cases and reports; rows of scores; lookups of many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A table of tab-separated values with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The members of JSON arrays of cases, each file one array over several lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def report(summary: DataFrame, path: str) -> None:
    """A summary as lines of JSON."""
    summary.write.json(path)


def scored(rows: DataFrame, score: Column, text: Column) -> DataFrame:
    """``rows`` with a number as ``score``; rows with a score that is none, or an empty text, go."""
    return rows.withColumn("score", F.trim(score).try_cast("double")).where(F.col("score").isNotNull() & (F.trim(text) != ""))


def looked_up(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of many keys (S16): Spark broadcasts the keys where they are small."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")
