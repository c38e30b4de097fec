"""Citation edges and what follows from them: validity, in-degrees, PageRank, treatment, authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import written
from .scalars import treatment_bits


def cites(citation_map: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row for each mention of a map edge, and rows without depth for anchors that the map lacks."""
    key = ["citing_id", "cited_id"]
    mapped = citation_map.join(anchors, key, "left").select(*key, "depth", "char_pos", "context")
    rest = anchors.join(citation_map, key, "left_anti").select(*key, F.lit(None).cast("long").alias("depth"), "char_pos", "context")
    return mapped.unionByName(rest)


def valid(cites: DataFrame, opinions: DataFrame) -> DataFrame:
    """Cites whose two ends exist."""
    ids = opinions.select("id")
    return cites.join(ids.withColumnRenamed("id", "citing_id"), "citing_id", "left_semi").join(
        ids.withColumnRenamed("id", "cited_id"), "cited_id", "left_semi"
    )


#: Pairs that a task makes distinct at once.
PAIRS_AT_ONCE = 500_000


def edges(cites: DataFrame, opinions: DataFrame, rows: int = 0) -> DataFrame:
    """Distinct (src, dst) of valid cites, of which only the pairs count. Pairs are distinct before the semi joins, which then move fewer rows.

    ``rows``: how many cites there are, if that is known. More than PAIRS_AT_ONCE are dealt to as many tasks as they need, whatever the
    session's partitions, so that no task grows with the input: adaptive execution would merge those to a few for each core, but not these.
    """
    pairs = cites.select("citing_id", "cited_id")
    if rows > PAIRS_AT_ONCE:
        pairs = pairs.repartition(max(-(-rows // PAIRS_AT_ONCE), cites.sparkSession.sparkContext.defaultParallelism), "citing_id", "cited_id")
    return valid(pairs.distinct(), opinions).select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"))


def recent_in_degree(edges: DataFrame, opinions: DataFrame, cutoff: str) -> DataFrame:
    """(id, recent) of all opinions: distinct citers filed from ``cutoff`` on."""
    late = opinions.where(F.col("date_filed") >= F.lit(cutoff).cast("date")).select(F.col("id").alias("src"))
    n = edges.join(late, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("recent"))
    return opinions.select("id").join(n, "id", "left").select("id", F.coalesce("recent", F.lit(0)).cast("long").alias("recent"))


def flags(cites: DataFrame) -> DataFrame:
    """(id, flags): treatment language of all contexts of a cited opinion, by OR, so that rows may repeat."""
    told = cites.where("context is not null").select(F.col("cited_id").alias("id"), treatment_bits(F.col("context")).alias("bits"))
    return told.where("bits <> 0").groupBy("id").agg(F.bit_or("bits").alias("flags"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-5, most: int = 150, exact: int | None = None
) -> tuple[DataFrame, int]:
    """(id, rank) of all ``nodes`` (id), and the rounds taken; dangling mass spreads evenly.

    Edges are distinct (src, dst) within the nodes, read once a round, so they had best be a table. A round is one join and one
    aggregate with partial sums, so that a node cited by a third of all others is
    no single task; degrees come with the ranks, and no edge is sorted for them. Each round's ranks are written to the shared folder, which cuts
    lineage; the L1 change decides whether to stop. ``exact`` runs that many rounds.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank")), 0
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    base = written(nodes.select("id").join(degree, "id", "left").select("id", "out"), "nodes")
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    lost = ranks.where("out is null").count() / n
    done = 0
    while done < (exact or most):
        into = edges.join(ranks.where("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src")
        into = into.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        rank = (1 - alpha) / n + alpha * lost / n + alpha * F.coalesce("got", F.lit(0.0))
        # The change and the dangling mass are summed while the round is written.
        seen = Observation()
        fresh = ranks.join(into, "id", "left").select("id", "out", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        fresh = fresh.observe(seen, F.sum("change").alias("change"), F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("lost"))
        ranks = written(fresh.select("id", "out", "rank"), "ranks")
        lost = seen.get["lost"] or 0.0
        done += 1
        if exact is None and seen.get["change"] < tolerance:
            break
    return ranks.select("id", "rank"), done


def authority(nodes: DataFrame, ranks: DataFrame, recent: DataFrame, flags: DataFrame) -> DataFrame:
    """One row for each opinion: (id, pagerank, recent, flags), 0 where a part is missing."""
    return (
        nodes.select("id")
        .join(ranks, "id", "left")
        .join(recent, "id", "left")
        .join(flags, "id", "left")
        .select(
            "id",
            F.coalesce("rank", F.lit(0.0)).alias("pagerank"),
            F.coalesce("recent", F.lit(0)).cast("long").alias("recent"),
            F.coalesce("flags", F.lit(0)).alias("flags"),
        )
    )


def reflagged(authority: DataFrame, cites: DataFrame) -> DataFrame:
    """``authority`` with flags computed anew over all contexts; stale ones become 0."""
    return authority.drop("flags").join(flags(cites), "id", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))


def cited_by(cites: DataFrame, opinions: DataFrame) -> DataFrame:
    """(cluster_id, cited_by): distinct unblocked citers, directly (depth 1) or in the text only, of each cluster's opinions."""
    cited = opinions.select(F.col("id").alias("cited_id"), "cluster_id")
    citers = opinions.where("not blocked").select(F.col("id").alias("citing_id"))
    direct = cites.where("depth = 1 or depth is null").select("citing_id", "cited_id").distinct()
    return (
        direct.join(citers, "citing_id", "left_semi").join(cited, "cited_id").groupBy("cluster_id").agg(F.count_distinct("citing_id").alias("cited_by"))
    )


def cocitations(cites: DataFrame, seeds: DataFrame, least: int = 2, limit: int = 60) -> DataFrame:
    """(citing_id, n): direct citers of ``least`` or more of the seeds (id), most first, ties by id."""
    found = cites.where("depth = 1").join(seeds.select(F.col("id").alias("cited_id")), "cited_id", "left_semi")
    n = found.groupBy("citing_id").agg(F.count_distinct("cited_id").alias("n"))
    return n.where(F.col("n") >= least).orderBy(F.desc("n"), "citing_id").limit(limit)


def subtree(courts: DataFrame, seeds: DataFrame, depth: int = 20) -> DataFrame:
    """Ids of the seeds (id) and of all courts below them, level by level until none is new; cycles end."""
    reached = seeds.select("id").distinct()
    frontier = reached
    for _ in range(depth):
        frontier = written(
            courts.join(frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").join(reached, "id", "left_anti").distinct(),
            "frontier",
        )
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached
