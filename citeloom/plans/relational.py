"""Queries of joins, aggregates, windows, sets and graphs over the corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, scalars
from ..sources.xml_sections import upsert
from .registry import query
from .views import Corpus

_BITS = (
    "(CASE WHEN regexp_matches(lower(context), '\\b(overrul|disapprov|supersed)|\\bdepart\\w* from\\b|\\bno longer (good law|controlling|followed|valid)\\b') THEN 1 ELSE 0 END"
    " + CASE WHEN contains(lower(context), 'abrogat') THEN 2 ELSE 0 END + CASE WHEN contains(lower(context), 'distinguish') THEN 4 ELSE 0 END"
    " + CASE WHEN regexp_matches(lower(context), '\\bbut see\\b') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(context), '\\bdeclined to follow\\b') THEN 16 ELSE 0 END)"
)
_CITED_BY = """, cb AS (SELECT o.cluster_id, count(DISTINCT c.citing_id) AS cited_by FROM cites c JOIN opinions o ON o.id = c.cited_id
  JOIN opinions s ON s.id = c.citing_id WHERE (c.depth = 1 OR c.depth IS NULL) AND NOT s.blocked GROUP BY o.cluster_id)"""
_FLAGS = f", fl AS (SELECT cited_id AS id, bit_or({_BITS})::INT AS flags FROM cites WHERE context IS NOT NULL GROUP BY 1)"


def _cites(c: Corpus) -> DataFrame:
    return graph.cites(c.citation_map, c.anchors)


@query(
    _CITED_BY
    + _FLAGS
    + """ SELECT cb.cluster_id, cited_by, coalesce(max(flags), 0) AS max_flags FROM cb JOIN opinions o USING (cluster_id) LEFT JOIN fl ON fl.id = o.id
    GROUP BY ALL ORDER BY cited_by DESC, cb.cluster_id LIMIT 20"""
)
def entry_top_cited(c: Corpus) -> DataFrame:
    """The 20 clusters most cited, with the largest treatment flags of their opinions."""
    cites = _cites(c)
    top = graph.cited_by(cites, c.opinions).orderBy(F.desc("cited_by"), "cluster_id").limit(20)
    members = c.opinions.select("id", "cluster_id").join(top, "cluster_id")
    told = graph.flags(cites.join(members.select(F.col("id").alias("cited_id")), "cited_id", "left_semi"))
    return members.join(told, "id", "left").groupBy("cluster_id", "cited_by").agg(F.coalesce(F.max("flags"), F.lit(0)).alias("max_flags"))


@query("SELECT citing_id, cited_id, depth, char_pos, context FROM cites")
def j5_cites(c: Corpus) -> DataFrame:
    return _cites(c)


@query("SELECT m.citing_id, m.cited_id, m.depth, a.char_pos FROM citation_map m LEFT JOIN anchors a USING (citing_id, cited_id)")
def j3_map_mentions(c: Corpus) -> DataFrame:
    return c.citation_map.join(c.anchors, ["citing_id", "cited_id"], "left").select("citing_id", "cited_id", "depth", "char_pos")


@query("SELECT a.citing_id, a.cited_id, a.char_pos FROM anchors a ANTI JOIN citation_map m USING (citing_id, cited_id)")
def j4_anchor_only(c: Corpus) -> DataFrame:
    return c.anchors.join(c.citation_map, ["citing_id", "cited_id"], "left_anti").select("citing_id", "cited_id", "char_pos")


@query("SELECT o.id, o.court_id, t.name AS court_name, coalesce(t.parent_id, '') AS parent_id FROM opinions o LEFT JOIN courts t ON t.id = o.court_id")
def j2_opinion_courts(c: Corpus) -> DataFrame:
    courts = c.courts.select(F.col("id").alias("court_id"), F.col("name").alias("court_name"), "parent_id")
    return c.opinions.select("id", "court_id").join(courts, "court_id", "left").select("id", "court_id", "court_name", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query(
    """SELECT s.volume, s.reporter, s.page, o.cluster_id, o.id FROM (SELECT DISTINCT * FROM citation_strings) s JOIN opinions o USING (cluster_id) WHERE NOT o.blocked
    QUALIFY row_number() OVER (PARTITION BY s.volume, s.reporter, s.page ORDER BY CASE WHEN contains(o.type, 'lead') THEN 0 WHEN contains(o.type, 'combined') THEN 1 ELSE 2 END, o.id) = 1"""
)
def j7_resolve_keys(c: Corpus) -> DataFrame:
    """Each citation key to its preferred unblocked opinion: leads first, then the lowest id."""
    found = c.citation_strings.distinct().join(c.opinions.where("not blocked").select("id", "cluster_id", "type"), "cluster_id")
    best = found.groupBy("volume", "reporter", "page").agg(F.min(F.struct(scalars.type_rank(F.col("type")).alias("rank"), "id", "cluster_id")).alias("best"))
    return best.select("volume", "reporter", "page", "best.cluster_id", "best.id")


@query(_FLAGS + " SELECT o.cluster_id, max(fl.flags) AS flags FROM opinions o JOIN fl USING (id) GROUP BY 1")
def j9_cluster_flags(c: Corpus) -> DataFrame:
    """The largest flags of each cluster (the number, not the OR)."""
    return c.opinions.select("id", "cluster_id").join(graph.flags(_cites(c)), "id").groupBy("cluster_id").agg(F.max("flags").alias("flags"))


@query(
    """SELECT 'cites.citing' AS target, count(*) AS n, count(*) FILTER (citing_id NOT IN (SELECT id FROM opinions)) AS orphans FROM cites
    UNION ALL SELECT 'cites.cited', count(*), count(*) FILTER (cited_id NOT IN (SELECT id FROM opinions)) FROM cites
    UNION ALL SELECT 'citation_strings.cluster', count(*), count(*) FILTER (cluster_id NOT IN (SELECT cluster_id FROM opinions)) FROM citation_strings
    UNION ALL SELECT 'parentheticals.described', count(*), count(*) FILTER (described_id NOT IN (SELECT id FROM opinions)) FROM parentheticals"""
)
def j12_orphans(c: Corpus) -> DataFrame:
    """Rows and those without a parent, for each foreign key."""

    def count(name: str, rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
        known = parents.select(F.col(parents.columns[0]).alias(key)).distinct().withColumn("known", F.lit(True))
        # One row for each key before the join: a hot key is one row.
        by_key = rows.groupBy(key).agg(F.count("*").alias("n"))
        return by_key.join(known, key, "left").agg(
            F.lit(name).alias("target"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans")
        )

    cites, ids = _cites(c), c.opinions.select("id")
    return (
        count("cites.citing", cites, "citing_id", ids)
        .union(count("cites.cited", cites, "cited_id", ids))
        .union(count("citation_strings.cluster", c.citation_strings, "cluster_id", c.opinions.select("cluster_id")))
        .union(count("parentheticals.described", c.parentheticals, "described_id", ids))
    )


@query("SELECT src, dst FROM edges")
def g1_edges(c: Corpus) -> DataFrame:
    return c.edges


@query("SELECT src AS id, count(*) AS n FROM edges GROUP BY 1")
def a11_out_degree(c: Corpus) -> DataFrame:
    return c.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


_RECENT = ", rc AS (SELECT e.dst AS id, count(*) AS recent FROM edges e JOIN opinions s ON s.id = e.src WHERE s.date_filed >= DATE '2020-06-30' GROUP BY 1)"


@query(_RECENT + " SELECT o.id, coalesce(rc.recent, 0) AS recent FROM opinions o LEFT JOIN rc USING (id)")
def a10_recent_cites(c: Corpus) -> DataFrame:
    return graph.recent_in_degree(c.edges, c.opinions, "2020-06-30")


@query(_FLAGS + " SELECT id, flags FROM fl WHERE flags <> 0")
def a8_treatment_flags(c: Corpus) -> DataFrame:
    return graph.flags(c.contexts)


RANKS = ", nn AS (SELECT count(*)::DOUBLE AS k FROM opinions), od AS (SELECT src, count(*)::DOUBLE AS outs FROM edges GROUP BY 1), r0 AS (SELECT id, 1 / k AS rank FROM opinions, nn)"
for _k in range(3):
    RANKS += (
        f", l{_k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{_k} WHERE id NOT IN (SELECT src FROM od)),"
        f" i{_k} AS (SELECT dst AS id, sum(r.rank / od.outs) AS got FROM edges JOIN r{_k} r ON r.id = src JOIN od USING (src) GROUP BY 1),"
        f" r{_k + 1} AS (SELECT o.id, 0.15 / k + 0.85 * lost / k + 0.85 * coalesce(got, 0) AS rank FROM opinions o LEFT JOIN i{_k} USING (id), nn, l{_k})"
    )


@query(RANKS + " SELECT id, round(rank * 1000, 6) AS rank_permille FROM r3")
def g2_pagerank_rounds(c: Corpus) -> DataFrame:
    """Three rounds of PageRank from even ranks, in thousandths."""
    ranks, _ = graph.pagerank(c.opinions.select("id"), c.written_edges, exact=3)
    return ranks.select("id", F.round(F.col("rank") * 1000, 6).alias("rank_permille"))


@query()
def g2_pagerank(c: Corpus) -> DataFrame:
    """PageRank to its tolerance."""
    ranks, _ = graph.pagerank(c.opinions.select("id"), c.written_edges)
    return ranks


@query(
    RANKS + _RECENT + _FLAGS + """ SELECT o.id, round(r3.rank * 1000, 6) AS rank_permille, coalesce(recent, 0) AS recent, coalesce(flags, 0) AS flags
    FROM opinions o LEFT JOIN r3 USING (id) LEFT JOIN rc USING (id) LEFT JOIN fl USING (id)"""
)
def g5_authority(c: Corpus) -> DataFrame:
    edges = c.written_edges
    ranks, _ = graph.pagerank(c.opinions.select("id"), edges, exact=3)
    rows = graph.authority(c.opinions, ranks, graph.recent_in_degree(edges, c.opinions, "2020-06-30"), graph.flags(c.contexts))
    return rows.select("id", F.round(F.col("pagerank") * 1000, 6).alias("rank_permille"), "recent", "flags")


@query(_FLAGS + " SELECT o.id, coalesce(flags, 0) AS flags FROM opinions o LEFT JOIN fl USING (id)")
def g6_reflag(c: Corpus) -> DataFrame:
    stale = c.opinions.select("id", F.lit(31).alias("flags"))
    return graph.reflagged(stale, c.contexts).select("id", "flags")


@query(_CITED_BY + " SELECT cluster_id, cited_by FROM cb")
def g7_cited_by(c: Corpus) -> DataFrame:
    return graph.cited_by(_cites(c), c.opinions)


@query(
    """SELECT citing_id, count(DISTINCT cited_id) AS n FROM cites WHERE depth = 1 AND cited_id IN (SELECT id FROM opinions WHERE id % 50 = 0) GROUP BY 1
    HAVING count(DISTINCT cited_id) >= 2 ORDER BY n DESC, citing_id LIMIT 60"""
)
def g9_cocitation(c: Corpus) -> DataFrame:
    """The 60 direct citers of two or more of the seeds (every fiftieth opinion)."""
    return graph.cocitations(_cites(c), c.opinions.where("id % 50 = 0"))


@query("SELECT id FROM courts WHERE id = 'r3' OR parent_id = 'r3'")
def u2_court_subtree(c: Corpus) -> DataFrame:
    """A court and all below it."""
    return graph.subtree(c.courts, c.courts.where("id = 'r3'"))


@query("SELECT id FROM courts WHERE contains(lower(name), 'ca') OR parent_id IN (SELECT id FROM courts WHERE contains(lower(name), 'ca'))")
def u3_court_name_subtrees(c: Corpus) -> DataFrame:
    """Courts whose name has a fragment, whatever its case, and all below them."""
    return graph.subtree(c.courts, c.courts.where(F.contains(F.lower("name"), F.lit("ca"))))


@query("SELECT count(*) AS n, count(text) AS with_text, round(100.0 * count(text) / count(*), 2) AS pct FROM opinions")
def a1_coverage(c: Corpus) -> DataFrame:
    return c.opinions.agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.round(100.0 * F.count("text") / F.count("*"), 2).alias("pct"))


@query("SELECT status, type, count(*) AS n FROM opinions GROUP BY ALL")
def a2_group_counts(c: Corpus) -> DataFrame:
    return c.opinions.groupBy("status", "type").agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS n, count_if(text IS NULL) AS null_text, count_if(ocr) AS ocr, count_if(blocked) AS blocked, min(date_filed) AS first, max(date_filed) AS last,
    round(avg(len(text)), 4) AS mean_chars, count_if(court_id NOT IN (SELECT id FROM courts)) AS bad_court FROM opinions"""
)
def a3_field_statistics(c: Corpus) -> DataFrame:
    """Counters of one pass over all opinions."""
    courts = c.courts.select(F.col("id").alias("court_id"), F.lit(True).alias("known"))
    rows = c.opinions.select("ocr", "blocked", "date_filed", "court_id", F.length("text").alias("chars")).join(courts, "court_id", "left")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("chars").isNull()).alias("null_text"), F.count_if("ocr").alias("ocr"), F.count_if("blocked").alias("blocked"),
        F.min("date_filed").alias("first"), F.max("date_filed").alias("last"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.count_if(F.col("known").isNull()).alias("bad_court"),
    )


@query(
    """SELECT kind, count(*) AS n, array_to_string((list(id ORDER BY id))[1:5], ',') AS samples FROM (SELECT id, unnest(list_filter(
    [CASE WHEN date_filed > DATE '2024-01-01' THEN 'future' END, CASE WHEN date_filed < DATE '2001-01-01' THEN 'ancient' END, CASE WHEN len(text) < 40 THEN 'short' END],
    lambda x: x IS NOT NULL)) AS kind FROM opinions) GROUP BY kind"""
)
def a4_outliers(c: Corpus) -> DataFrame:
    """Outliers by kind, with the five smallest ids of each: top-5 by a window over (kind, id) only."""
    kinds = F.array_compact(
        F.array(F.when(F.col("date_filed") > "2024-01-01", "future"), F.when(F.col("date_filed") < "2001-01-01", "ancient"), F.when(F.length("text") < 40, "short"))
    )
    rows = c.opinions.select("id", F.explode(kinds).alias("kind"))
    n = rows.groupBy("kind").agg(F.count("*").alias("n"))
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where("r <= 5")
    some = least.groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    return n.join(some, "kind").select("kind", "n", "samples")


@query(
    """, k AS (SELECT volume, reporter, page, count(DISTINCT cluster_id) AS n FROM citation_strings GROUP BY ALL)
    SELECT count(*) AS keys, count_if(n > 1) AS colliding, round(100.0 * count_if(n > 1) / count(*), 4) AS pct FROM k"""
)
def a7_key_collisions(c: Corpus) -> DataFrame:
    k = c.citation_strings.groupBy("volume", "reporter", "page").agg(F.count_distinct("cluster_id").alias("n"))
    several = F.count_if(F.col("n") > 1)
    return k.agg(F.count("*").alias("keys"), several.alias("colliding"), F.round(100.0 * several / F.count("*"), 4).alias("pct"))


@query("SELECT described_id, count(*) AS n FROM parentheticals GROUP BY 1 ORDER BY n DESC, described_id LIMIT 100")
def o3_most_described(c: Corpus) -> DataFrame:
    n = c.parentheticals.groupBy("described_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "described_id").limit(100)


@query(
    """, s AS (SELECT list(len(text) ORDER BY len(text)) AS xs, count(*) AS n FROM opinions)
    SELECT xs[(n * 10 // 100) + 1] AS p10, xs[(n * 50 // 100) + 1] AS p50, xs[(n * 90 // 100) + 1] AS p90 FROM s"""
)
def a16_index_percentiles(c: Corpus) -> DataFrame:
    """Values at floor(n * p) of the sorted text lengths, from counts of each length: no list of all values."""
    counts = c.opinions.groupBy(F.length("text").cast("long").alias("chars")).agg(F.count("*").alias("k"))
    spans = counts.withColumn("upto", F.sum("k").over(Window.orderBy("chars")))
    n = F.max("upto").over(Window.partitionBy())
    ranked = spans.withColumn("n", n)
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("chars")))
    return ranked.agg(pick(10).alias("p10"), pick(50).alias("p50"), pick(90).alias("p90"))


@query(
    """SELECT count(*) AS total, count(DISTINCT (citing_id, cited_id)) AS pairs, count(*) - count(DISTINCT (citing_id, cited_id)) AS dup,
    count_if(depth IS NULL) AS no_depth, count_if(depth = 1) AS depth_1 FROM cites"""
)
def a23_duplicates(c: Corpus) -> DataFrame:
    per_pair = _cites(c).groupBy("citing_id", "cited_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("depth").isNull()).alias("none"), F.count_if(F.col("depth") == 1).alias("one")
    )
    return per_pair.agg(
        F.sum("n").alias("total"), F.count("*").alias("pairs"), (F.sum("n") - F.count("*")).alias("dup"), F.sum("none").alias("no_depth"), F.sum("one").alias("depth_1")
    )


@query(
    """, o AS (SELECT year(date_filed) // 10 * 10 AS decade, count(*) AS n FROM opinions GROUP BY 1), p AS (SELECT year(date_filed) // 10 * 10 AS decade, count(*) AS n FROM opinions WHERE NOT blocked GROUP BY 1)
    SELECT decade, coalesce(o.n, 0) AS old_n, coalesce(p.n, 0) AS new_n, coalesce(p.n, 0) - coalesce(o.n, 0) AS diff FROM o FULL JOIN p USING (decade)"""
)
def a22_differential(c: Corpus) -> DataFrame:
    """Counts of two versions of a table by decade, and their difference."""
    by = lambda rows, name: rows.groupBy((F.floor(F.year("date_filed") / 10) * 10).alias("decade")).agg(F.count("*").alias(name))
    both = by(c.opinions, "o").join(by(c.opinions.where("not blocked"), "p"), "decade", "full")
    old, new = F.coalesce("o", F.lit(0)), F.coalesce("p", F.lit(0))
    return both.select("decade", old.alias("old_n"), new.alias("new_n"), (new - old).alias("diff"))


@query(
    """SELECT s.reporter, count(*) AS n, count(o.cluster_id) AS resolved, round(100.0 * count(o.cluster_id) / count(*), 4) AS pct FROM citation_strings s
    LEFT JOIN (SELECT DISTINCT cluster_id FROM opinions WHERE NOT blocked AND status <> 'Unpublished') o USING (cluster_id) GROUP BY 1"""
)
def a20_resolve_rates(c: Corpus) -> DataFrame:
    """How many citation strings resolve, by reporter."""
    ok = c.opinions.where("not blocked and status <> 'Unpublished'").select("cluster_id").distinct().withColumn("ok", F.lit(1))
    rows = c.citation_strings.groupBy("cluster_id", "reporter").agg(F.count("*").alias("k")).join(ok, "cluster_id", "left")
    n, good = F.sum("k"), F.sum(F.when(F.col("ok") == 1, F.col("k")).otherwise(0))
    return rows.groupBy("reporter").agg(n.alias("n"), good.alias("resolved"), F.round(100.0 * good / n, 4).alias("pct"))


@query(
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def j19_latest_run(c: Corpus) -> DataFrame:
    """The latest row of each case, by one aggregate."""
    return c.table("events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x")).select("user_id", "x.*")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) = 1")
def s18_upsert(c: Corpus) -> DataFrame:
    """Last write wins on the key: the later half of the events on the first writes of the earlier half."""
    events = c.table("events").select("user_id", "event_type", "value", "event_id")
    early = events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "event_id"), "event_id").alias("x")).select("user_id", "event_type", "x.*")
    late = events.where("event_id % 2 = 1")
    return upsert(early, late, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def s19_ignore_duplicates(c: Corpus) -> DataFrame:
    """First write wins on the key."""
    return c.table("events").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))


@query("SELECT user_id, event_type || ':' || (CASE WHEN value > 5 THEN 'high' ELSE 'low' END) AS kind, count(*) AS n FROM events GROUP BY ALL")
def a14_summary_map(c: Corpus) -> DataFrame:
    """Counts by ``kind:status`` of each case; as a map with map_from_entries, here as rows."""
    kind = F.concat_ws(":", "event_type", F.when(F.col("value") > 5, "high").otherwise("low"))
    return c.table("events").groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_and(value < 100) AS all_small, count_if(value > 5) / count(*) > 0.5 AS mostly_high FROM events GROUP BY 1")
def a15_verdicts(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") < 100).alias("all_small"),
        (F.count_if(F.col("value") > 5) / F.count("*") > 0.5).alias("mostly_high"),
    )


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 12")
def o5_last_audit_rows(c: Corpus) -> DataFrame:
    """The last 12 audit rows of a case."""
    return c.table("events").where("user_id = 7").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(12)


@query(
    """SELECT cluster_id, reporter, volume, page FROM citation_strings QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY
    CASE WHEN reporter IN ('U.S.', 'S. Ct.') THEN 0 ELSE 1 END, volume::INT, page::INT, reporter) = 1"""
)
def o6_primary_cite(c: Corpus) -> DataFrame:
    """The preferred citation of each cluster: official reporters first, then volume and page as numbers."""
    rank = F.when(F.col("reporter").isin("U.S.", "S. Ct."), 0).otherwise(1)
    best = F.min(F.struct(rank.alias("r"), F.col("volume").cast("int").alias("v"), F.col("page").cast("int").alias("p"), "reporter", "volume", "page"))
    return c.citation_strings.groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", "b.reporter", "b.volume", "b.page")


@query("SELECT cluster_id, id FROM opinions QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY len(text) DESC, id) = 1")
def w1_best_of_cluster(c: Corpus) -> DataFrame:
    """The best row of each cluster: the longest text, ties by id."""
    return c.opinions.groupBy("cluster_id").agg(F.max_by("id", F.struct(F.length("text"), -F.col("id"))).alias("id"))


@query(
    """, s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, event_id, event_type FROM s WHERE before IS NULL OR before <> event_type"""
)
def w7_adjacent_duplicates(c: Corpus) -> DataFrame:
    """Rows that differ from the one before them in their case."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return c.table("events").withColumn("before", before).where("before is null or before <> event_type").select("user_id", "event_id", "event_type")


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS r FROM opinions) WHERE (r - 1) % 7 = 0 AND r <= 35")
def w6_strided_sample(c: Corpus) -> DataFrame:
    """Every seventh opinion of each court, five at most."""
    r = F.row_number().over(Window.partitionBy("court_id").orderBy("id"))
    return c.opinions.select("id", "court_id").withColumn("r", r).where("(r - 1) % 7 = 0 and r <= 35").select("id")


@query("SELECT id FROM opinions WHERE (id * 7919 + 20260920) % 1000 < 50")
def q1_seeded_sample(c: Corpus) -> DataFrame:
    """A sample by a seeded residue of the id; it grows with the table."""
    return c.opinions.where("(id * 7919 + 20260920) % 1000 < 50").select("id")


@query("SELECT id, year(date_filed) // 10 * 10 AS decade FROM opinions QUALIFY row_number() OVER (PARTITION BY year(date_filed) // 10 ORDER BY (id * 7919) % 10007, id) <= 20")
def q2_stratified_sample(c: Corpus) -> DataFrame:
    """Twenty opinions of each decade, by a seeded order."""
    decade = (F.floor(F.year("date_filed") / 10) * 10).alias("decade")
    r = F.row_number().over(Window.partitionBy("decade").orderBy((F.col("id") * 7919) % 10007, "id"))
    return c.opinions.select("id", decade).withColumn("r", r).where("r <= 20").select("id", "decade")


@query(
    """SELECT described_id, describing_id, text FROM parentheticals WHERE len(text) BETWEEN 60 AND 1500
    QUALIFY row_number() OVER (PARTITION BY described_id ORDER BY len(text), describing_id, text) <= 2"""
)
def q5_ground_truth(c: Corpus) -> DataFrame:
    """Two parentheticals of each described opinion at most, as queries with a known answer."""
    rows = c.parentheticals.where(F.length("text").between(60, 1500))
    r = F.row_number().over(Window.partitionBy("described_id").orderBy(F.length("text"), "describing_id", "text"))
    return rows.withColumn("r", r).where("r <= 2").drop("r", "id")


@query(
    """SELECT 'opinions' AS gate, count(*) AS n, count(*) >= 100 AS ok FROM opinions UNION ALL SELECT 'cites', count(*), count(*) >= 100 FROM cites
    UNION ALL SELECT 'courts', count(*), count(*) = 30 FROM courts"""
)
def q6_gates(c: Corpus) -> DataFrame:
    """Minimum row counts."""
    gate = lambda name, rows, ok: rows.agg(F.lit(name).alias("gate"), F.count("*").alias("n"), ok(F.count("*")).alias("ok"))
    return (
        gate("opinions", c.opinions, lambda n: n >= 100).union(gate("cites", _cites(c), lambda n: n >= 100)).union(gate("courts", c.courts, lambda n: n == 30))
    )


@query("SELECT id, court_id, status FROM opinions WHERE status IN ('Published', 'Unknown') AND NOT blocked AND court_id IN (SELECT id FROM courts WHERE id = 'r1' OR parent_id = 'r1')")
def p8_search_filters(c: Corpus) -> DataFrame:
    """Searchable opinions of one court's subtree."""
    below = graph.subtree(c.courts, c.courts.where("id = 'r1'")).withColumnRenamed("id", "court_id")
    return c.opinions.where(scalars.searchable()).select("id", "court_id", "status").join(below, "court_id", "left_semi").select("id", "court_id", "status")


@query(
    """SELECT cluster_id, min(id) AS id, list_aggregate(list_distinct(list(list_no)), 'min') AS list_no FROM
    (SELECT cluster_id, id, id % 3 AS list_no FROM opinions QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY id % 3, id) = 1) GROUP BY cluster_id"""
)
def u4_merge_lists(c: Corpus) -> DataFrame:
    """Result lists merged by cluster, the first list winning."""
    lists = [c.opinions.where(f"id % 3 = {k}").select("cluster_id", "id", F.lit(k).cast("long").alias("list_no")) for k in range(3)]
    rows = lists[0].union(lists[1]).union(lists[2])
    return rows.groupBy("cluster_id").agg(F.min(F.struct("list_no", "id")).alias("x")).select("cluster_id", "x.id", "x.list_no")
