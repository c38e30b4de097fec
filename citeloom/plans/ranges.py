"""Queries of range joins, evaluation metrics, audits and draft assembly over the corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, scalars, verify
from .registry import query
from .relational import RANKS
from .views import Corpus

#: Ranges by rule: five sentences of 90 characters, four checks and three quotes for each opinion.
_RANGES = """, sentences AS (SELECT id, k AS n, 100 * k AS s0, 100 * k + 90 AS s1 FROM opinions, range(0, 5) t(k)),
checks AS (SELECT id, k AS idx, (id * 13 + 97 * k) % 450 AS c0, (id * 13 + 97 * k) % 450 + 20 AS c1 FROM opinions, range(0, 4) t(k)),
quotes AS (SELECT id, k AS q, (id * 29 + 151 * k) % 450 AS q0, (id * 29 + 151 * k) % 450 + 30 AS q1 FROM opinions, range(0, 3) t(k)) """


def _ranged(c: Corpus, n: int, name: str, start: str, size: int, low: str, high: str) -> DataFrame:
    rows = c.opinions.select("id", F.expr(f"explode(sequence(0L, {n - 1}L))").alias(name))
    return rows.withColumn(low, F.expr(start)).withColumn(high, F.col(low) + size)


def _sentences(c: Corpus) -> DataFrame:
    return _ranged(c, 5, "n", "100 * n", 90, "s0", "s1")


def _checks(c: Corpus) -> DataFrame:
    return _ranged(c, 4, "idx", "(id * 13 + 97 * idx) % 450", 20, "c0", "c1")


def _quotes(c: Corpus) -> DataFrame:
    return _ranged(c, 3, "q", "(id * 29 + 151 * q) % 450", 30, "q0", "q1")


@query(_RANGES + "SELECT s.id, s.n, count(*) AS n_checks FROM sentences s JOIN checks c ON c.id = s.id AND c.c0 >= s.s0 AND c.c1 <= s.s1 GROUP BY ALL")
def j16_contained_checks(c: Corpus) -> DataFrame:
    """Checks inside each sentence."""
    both = _sentences(c).join(_checks(c), "id").where("c0 >= s0 and c1 <= s1")
    return both.groupBy("id", "n").agg(F.count("*").alias("n_checks"))


@query(_RANGES + "SELECT c.id, c.idx FROM checks c WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.id = c.id AND c.c0 < q.q1 AND q.q0 < c.c1)")
def j17_without_overlap(c: Corpus) -> DataFrame:
    """Checks that overlap no quote of their opinion."""
    checks, quotes = _checks(c).alias("c"), _quotes(c).alias("q")
    return checks.join(quotes, (F.col("c.id") == F.col("q.id")) & (F.col("c0") < F.col("q1")) & (F.col("q0") < F.col("c1")), "left_anti").select("id", "idx")


@query(_RANGES + "SELECT q.id, q.q FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM sentences s WHERE s.id = q.id AND s.n % 2 = 0 AND q.q0 >= s.s0 AND q.q1 <= s.s1)")
def j18_outside_skipped(c: Corpus) -> DataFrame:
    """Quotes that no skipped range holds whole."""
    skipped, quotes = _sentences(c).where("n % 2 = 0").alias("s"), _quotes(c).alias("q")
    return quotes.join(skipped, (F.col("q.id") == F.col("s.id")) & (F.col("q0") >= F.col("s0")) & (F.col("q1") <= F.col("s1")), "left_anti").select("id", "q")


@query(
    _RANGES
    + """, p AS (SELECT q.id, q.q, c.idx, c.c0, c.c1, c.c1 <= q.q0 AS before, c.c0 >= q.q1 AND c.c0 - q.q1 <= 300 AS after FROM quotes q JOIN checks c ON c.id = q.id)
    SELECT id, q, coalesce(max_by(idx, c1 * 10 + idx) FILTER (before), min_by(idx, c0 * 10 + idx) FILTER (after)) AS idx FROM p GROUP BY id, q"""
)
def j15_attribution(c: Corpus) -> DataFrame:
    """Each quote's citation: the last that ends before it, else the next within 300 characters."""
    checks = _checks(c).select(F.col("id").alias("draft_id"), F.col("c0").alias("start"), F.col("c1").alias("end"), "idx", F.lit(0).alias("cluster_id"), F.col("id"), F.lit("verified").alias("status"))
    quotes = _quotes(c).select(F.col("id").alias("draft_id"), "q", F.col("q0").alias("start"), F.col("q1").alias("end"))
    got = verify.attributed(quotes.dropDuplicates(["draft_id", "start"]), checks).select("draft_id", "start", "idx")
    return quotes.join(got, ["draft_id", "start"]).select(F.col("draft_id").alias("id"), "q", "idx")


@query("SELECT o.cluster_id, count(*) AS opinions, count(t.id) AS with_court, max(t.name) AS court_name FROM opinions o LEFT JOIN courts t ON t.id = o.court_id GROUP BY 1")
def j1_cluster_courts(c: Corpus) -> DataFrame:
    courts = c.courts.select(F.col("id").alias("court_id"), "name")
    rows = c.opinions.select("cluster_id", "court_id").join(courts, "court_id", "left")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("opinions"), F.count("name").alias("with_court"), F.max("name").alias("court_name"))


@query("SELECT a.id, b.id AS sibling FROM opinions a JOIN opinions b ON b.cluster_id = a.cluster_id AND b.id <> a.id WHERE NOT b.blocked")
def j14_siblings(c: Corpus) -> DataFrame:
    """Other unblocked opinions of each opinion's cluster."""
    other = c.opinions.where("not blocked").select(F.col("id").alias("sibling"), "cluster_id")
    return c.opinions.select("id", "cluster_id").join(other, "cluster_id").where("id <> sibling").select("id", "sibling")


@query(
    """SELECT s.cluster_id, s.volume, s.reporter, s.page, o.id, t.name AS court FROM (SELECT DISTINCT * FROM citation_strings) s
    LEFT JOIN (SELECT * FROM opinions WHERE type = '020lead' AND NOT blocked) o USING (cluster_id) LEFT JOIN courts t ON t.id = o.court_id"""
)
def j20_hand_check(c: Corpus) -> DataFrame:
    """Citation strings with their lead opinion and its court, where there are any."""
    lead = c.opinions.where("type = '020lead' and not blocked").select("cluster_id", "id", "court_id")
    courts = c.courts.select(F.col("id").alias("court_id"), F.col("name").alias("court"))
    rows = c.citation_strings.distinct().join(lead, "cluster_id", "left").join(courts, "court_id", "left")
    return rows.select("cluster_id", "volume", "reporter", "page", "id", "court")


@query(RANKS + " SELECT id, cluster_id, round(rank * 1000, 6) AS rank_permille FROM r3 JOIN opinions USING (id) ORDER BY rank DESC, id LIMIT 5")
def j21_top_authorities(c: Corpus) -> DataFrame:
    """The five opinions of the highest rank after three rounds."""
    edges = c.written_edges
    ranks, _ = graph.pagerank(c.opinions.select("id"), edges, exact=3)
    top = ranks.orderBy(F.desc("rank"), "id").limit(5).join(c.opinions.select("id", "cluster_id"), "id")
    return top.select("id", "cluster_id", F.round(F.col("rank") * 1000, 6).alias("rank_permille"))


@query(
    """, f AS (SELECT DISTINCT cited_id AS id FROM cites WHERE contains(context, 'overruled')) SELECT o.id, min(s.volume || ' ' || s.reporter || ' ' || s.page) AS citation FROM opinions o
    JOIN f USING (id) JOIN citation_strings s USING (cluster_id) WHERE o.status = 'Published' AND NOT o.blocked AND len(o.text) > 2000 GROUP BY o.id ORDER BY o.id LIMIT 20"""
)
def j22_overruled_long(c: Corpus) -> DataFrame:
    """Twenty long published opinions that were overruled, with a citation."""
    told = graph.flags(c.contexts).where(F.col("flags").bitwiseAND(F.lit(1)) == 1).select("id")
    overruled = c.contexts.where(F.col("context").contains("overruled")).select(F.col("cited_id").alias("id")).distinct()
    long = c.opinions.where("status = 'Published' and not blocked and length(text) > 2000").select("id", "cluster_id")
    rows = long.join(told, "id", "left_semi").join(overruled, "id", "left_semi").join(c.citation_strings, "cluster_id")
    return rows.groupBy("id").agg(F.min(F.concat_ws(" ", "volume", "reporter", "page")).alias("citation")).orderBy("id").limit(20)


# ------------------------------------------------------------------ evaluation

#: Sentences of treatment, with whether they tell that a case is overruled.
TREATED = (
    ("That holding was overruled in the spring term", True),
    ("The tolls statute superseded this rule", True),
    ("We depart from that view today", True),
    ("The dicta are disapproved of here", True),
    ("It is no longer good law", True),
    ("The clerk ruled over the matter", False),
    ("A pier stood no longer than a year", False),
    ("The court overlooked the weir", False),
    ("They departed for the harbor", False),
    ("An override key opens the lock", False),
)
_TREATED = ", ".join(f"{{'s': '{t}', 'y': {str(y).lower()}}}" for t, y in TREATED)


@query(
    f""", s AS (SELECT [{_TREATED}][(char_pos % {len(TREATED)})::INT + 1] AS x FROM anchors), t AS (SELECT s.x.y AS truth, regexp_matches(lower(s.x.s), '\\b(overrul|disapprov|supersed|depart\\w* from\\b)|\\bno longer (good law|controlling|followed|valid)\\b') AS found FROM s)
    SELECT count(*) AS n, round(count_if(truth AND found) / count_if(truth), 6) AS recall, round(count_if(NOT truth AND found) / count_if(NOT truth), 6) AS false_positives FROM t"""
)
def a21_treatment_recall(c: Corpus) -> DataFrame:
    """Recall and false positive rate of the overruled flag over labelled sentences, one for each anchor."""
    sentences = F.array(*[F.struct(F.lit(t).alias("s"), F.lit(y).alias("y")) for t, y in TREATED])
    s = c.anchors.select(F.get(sentences, (F.col("char_pos") % len(TREATED)).cast("int")).alias("x"))
    s = s.select(F.col("x.y").alias("truth"), (scalars.treatment_bits(F.col("x.s")).bitwiseAND(F.lit(1)) == 1).alias("found"))
    rate = lambda of: F.round(F.count_if(of & F.col("found")) / F.count_if(of), 6)
    return s.agg(F.count("*").alias("n"), rate(F.col("truth")).alias("recall"), rate(~F.col("truth")).alias("false_positives"))


# ----------------------------------------------------------------------- audits


@query(
    """, f AS (SELECT id, text, substr(text, 41, 20) AS part, 40 + id % 6 AS pos FROM opinions WHERE len(text) > 80)
    SELECT id, substr(text, pos + 1, 20) = part AS exact, len(list_filter(range(-3, 4), lambda k: substr(text, pos + 1 + k, 20) = part)) > 0 AS near FROM f"""
)
def x25_offsets(c: Corpus) -> DataFrame:
    """Whether fragments stand where their offsets say, exactly or within three characters; some offsets are off."""
    part, at = F.substring("text", 41, 20), F.col("id") % 6 + 40
    rows = c.opinions.where("length(text) > 80").select("id", "text", part.alias("part"), at.cast("int").alias("at"))
    return rows.select("id", F.expr("substring(text, at + 1, 20) = part").alias("exact"), F.expr("instr(substring(text, at - 2, 26), part) > 0").alias("near"))


@query("SELECT citing_id, cited_id, char_pos, regexp_matches(context, '[a-z]{3,} [a-z]{2,} [a-z]{2,}') AS prose, regexp_matches(context, '\\d+ [A-Z][a-z.]+ \\d+') AS cite FROM anchors")
def x26_coherence(c: Corpus) -> DataFrame:
    """Whether contexts look like prose or like citations."""
    return c.anchors.select(
        "citing_id", "cited_id", "char_pos", F.col("context").rlike("[a-z]{3,} [a-z]{2,} [a-z]{2,}").alias("prose"), F.col("context").rlike(r"\d+ [A-Z][a-z.]+ \d+").alias("cite")
    )


@query(
    """, r AS (SELECT o_orderkey AS id, ['at 12', '113', '12-14 n.3', 'passim', ''][(o_orderkey % 5)::INT + 1] AS pin, ['[IRAC:rule] x', 'plain', '[COUNTER-ARGUMENT] y', '[IRAC:issue]z', '[IRAC:] q'][(o_orderkey % 5)::INT + 1] AS t FROM orders)
    SELECT id, CASE WHEN regexp_matches(pin, '\\d') AND NOT regexp_matches(pin, '^\\d+$') THEN pin END AS pin, nullif(regexp_extract(t, '^\\[IRAC:(\\w+)\\]', 1), '') AS field, starts_with(t, '[COUNTER-ARGUMENT]') AS counter,
    trim(regexp_replace(t, '^\\[(IRAC:\\w+|COUNTER-ARGUMENT)\\]', '')) AS body FROM r"""
)
def x28_pins_and_markers(c: Corpus) -> DataFrame:
    """Pin citations that aren't bare numbers; markers and what they mark."""
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("o_orderkey") % 5).cast("int"))
    pin, t = pick("at 12", "113", "12-14 n.3", "passim", ""), pick("[IRAC:rule] x", "plain", "[COUNTER-ARGUMENT] y", "[IRAC:issue]z", "[IRAC:] q")
    return c.table("orders").select(
        F.col("o_orderkey").alias("id"), F.when(pin.rlike(r"\d") & ~pin.rlike(r"^\d+$"), pin).alias("pin"), F.nullif(F.regexp_extract(t, r"^\[IRAC:(\w+)\]", 1), F.lit("")).alias("field"),
        t.startswith("[COUNTER-ARGUMENT]").alias("counter"), F.trim(F.regexp_replace(t, r"^\[(IRAC:\w+|COUNTER-ARGUMENT)\]", "")).alias("body"),
    )


# --------------------------------------------------------------- draft assembly


@query(
    """, b AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations)
    SELECT conv_id, count(*) AS blocks, sha256(string_agg(CASE role WHEN 'system' THEN '1' WHEN 'user' THEN '2' ELSE '3' END || ' ' || text, chr(10) || chr(10)
    ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, turn)) AS digest FROM b WHERE r = 1 GROUP BY conv_id"""
)
def v14_draft_blocks(c: Corpus) -> DataFrame:
    """Blocks routed to sections by role, repeated ones once, in order, flattened and digested. A draft's blocks are its own size."""
    section = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    once = c.table("conversations").groupBy("conv_id", "text").agg(F.min_by(F.struct("turn", section.alias("section")), "turn").alias("x"))
    blocks = F.array_sort(F.collect_list(F.struct("x.section", "x.turn", "text")))
    body = F.array_join(F.transform(blocks, lambda b: F.concat(b["section"].cast("string"), F.lit(" "), b["text"])), "\n\n")
    return once.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.sha2(body, 256).alias("digest"))


@query(
    """, d AS (SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS j, '{"event_type":"' || CASE WHEN event_id % 9 = 0 THEN 'edited' ELSE event_type END || '","user_id":' || user_id || '}' AS k FROM events)
    SELECT event_id, sha256(j) AS digest, CASE WHEN sha256(j) <> sha256(k) THEN 'digest mismatch' ELSE 'ok' END AS problem FROM d"""
)
def v13_certificates(c: Corpus) -> DataFrame:
    """Certificates of drafts by the digest of canonical JSON, and whether a later draft still has it."""
    digest = lambda kind: F.sha2(F.to_json(F.struct(kind.alias("event_type"), "user_id")), 256)
    later = F.when(F.col("event_id") % 9 == 0, "edited").otherwise(F.col("event_type"))
    return c.table("events").select(
        "event_id", digest(F.col("event_type")).alias("digest"), F.when(digest(F.col("event_type")) != digest(later), "digest mismatch").otherwise("ok").alias("problem")
    )


@query("SELECT DISTINCT volume || ' ' || reporter || ' ' || page AS citation FROM citation_strings")
def u5_distinct_citations(c: Corpus) -> DataFrame:
    return c.citation_strings.select(F.concat_ws(" ", "volume", "reporter", "page").alias("citation")).distinct()


@query("SELECT id, name FROM courts WHERE contains(lower(name), lower('nAtion_1')) OR lower(name) = lower('EUROPE')")
def p9_name_matches(c: Corpus) -> DataFrame:
    """Names that hold a fragment or equal another, whatever their case."""
    low = F.lower("name")
    return c.courts.where(low.contains("nation_1") | (low == "europe")).select("id", "name")
