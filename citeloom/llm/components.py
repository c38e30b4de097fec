"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import batches, join_by_key, written

#: A node with more neighbours than this, and than a thousandth of all links, is a hub: there are 2,000 at most.
HUB = 100


#: Links that a task looks at together before the first round; and so few that one task settles them (three megabytes), where rounds would cost more than their links.
TOGETHER, FEW = 1_000_000, 200_000


def lowest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these links but the smallest of each component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        before = low.copy()
        for end in (low[x], low[y], x, y):  # roots and ends take what their neighbours know
            np.minimum.at(low, end, least)
        low = low[low]
        if (low == before).all():
            break
    other = low != np.arange(len(nodes))
    return nodes[other], nodes[low[other]]


def _contracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links, some at a time, as stars, so that few rounds are needed."""

    def stars(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from batches([tuple(pa.array(x) for x in lowest_of(*np.concatenate(held, axis=1)))], ["a", "b"])

    held, n = [], 0
    for part in parts:
        held.append(np.stack([part.column(c).to_numpy() for c in range(2)]))
        n += len(part)
        if n > TOGETHER:
            yield from stars(held)
            held, n = [], 0
    yield from stars(held)


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a table of distinct links, with their number and checksum, taken while it is written."""
    seen = Observation()
    edges = edges.mapInArrow(_contracted, "a long, b long").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    edges = written(edges, "edges")
    return edges, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(a, b)`` links to ``(id, component_id)``, the smallest id that links reach, for every id in a link.

    Large-star and small-star steps alternate: each hangs neighbours on the
    smallest one known. Minima are aggregates that combine before the shuffle,
    and return to a hub's neighbours by broadcast. Up to FEW links are settled in one task,
    with the same result. Steps are some in the logarithm
    of the longest path; ``rounds`` is a guard that ends a job which doesn't get
    to a fixed point with an error, never with a part of the result. Null ends and
    loops are ignored; an empty table gives an empty table.
    """
    edges, now = _kept(
        links.where("a is not null and b is not null and a <> b").select("a", "b")
    )
    if now[0] <= FEW:
        edges, rounds = written(edges.coalesce(1).mapInArrow(_contracted, "a long, b long"), "edges"), 0
    for _ in range(rounds):
        before, most = now, max(HUB, now[0] // 1000)
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_by_key(both.where("b > a"), low, ["a"], most).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = (
            join_by_key(large, low, ["a"], most)
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.low").alias("b"))
            .where("a <> b")
        )
        edges, now = _kept(small)
        if now == before:
            break
    else:
        if rounds:
            raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
