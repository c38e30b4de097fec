"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Register a function of a Corpus under its name; ``sql`` continues the views' WITH clause unless ``views`` is false."""

    def add(make: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Corpus(spark, sf_dir))
        if sql:
            SQL[make.__name__] = VIEWS + sql if views else sql
        return make

    return add
