"""Operators of the corpus engine on small vectors."""

import bz2
import datetime as dt
import io
import random
import re
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import plans
from citeloom.functions import prints
from citeloom.functions import text as T
from citeloom.operators import calendar, evaluate, graph, scalars, search, verify
from citeloom.plans.views import Corpus
from citeloom.sources import bz2_blocks, csv_shards, xml_sections
from citeloom.streaming import audit


def test_authority(spark):
    d = dt.date
    nodes = spark.createDataFrame([(1, d(2020, 1, 1)), (2, d(2025, 6, 1)), (3, d(2024, 7, 15)), (4, d(2019, 5, 5)), (5, d(2026, 1, 2))], "id long, date_filed date")
    rows = [(2, 1, None), (3, 1, None), (3, 2, None), (4, 3, None), (5, 1, "It was overruled in a later case."), (5, 1, "duplicate pair"), (4, 999, "x"), (998, 1, "x"), (5, 4, "But see Weir v. Lock.")]
    cites = spark.createDataFrame(rows, "citing_id long, cited_id long, context string")
    edges = graph.edges(cites, nodes)
    assert {tuple(r) for r in edges.collect()} == {(2, 1), (3, 1), (3, 2), (4, 3), (5, 1), (5, 4)}
    ranks, rounds = graph.pagerank(nodes.select("id"), edges, tolerance=1e-12)
    got = {r["id"]: r["rank"] for r in ranks.collect()}
    assert rounds > 5 and abs(sum(got.values()) - 1) < 1e-9
    want = [0.37901198, 0.18317749, 0.20881284, 0.13456565, 0.09443204]
    assert all(abs(got[k + 1] - w) < 1e-7 for k, w in enumerate(want))
    recent = {r["id"]: r["recent"] for r in graph.recent_in_degree(edges, nodes, "2024-06-30").collect()}
    assert recent == {1: 3, 2: 1, 3: 0, 4: 1, 5: 0}
    flags = {r["id"]: r["flags"] for r in graph.flags(cites).collect()}
    assert flags == {1: 1, 4: 8}
    authority = graph.authority(nodes, ranks, graph.recent_in_degree(edges, nodes, "2024-06-30"), graph.flags(cites))
    assert authority.count() == 5
    neutral = cites.withColumn("context", F.lit("neutral"))
    assert {r["flags"] for r in graph.reflagged(authority, neutral).collect()} == {0}


def test_edges_without_the_join_of_cites(spark):
    """The pairs of the map and of the anchors are those of their cites, so that edges need no join of both."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    want = graph.edges(graph.cites(c.citation_map, c.anchors), c.opinions)
    got = plans.queries()["g1_edges"](spark, c.sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "LeftAnti" not in plan


def test_edges_of_a_task_stay_few(spark, monkeypatch):
    """Pairs are dealt by their number where the session has more partitions than that too, which adaptive execution would merge to a few."""
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        cites = spark.range(4000).select((F.col("id") % 50).alias("citing_id"), F.floor(F.col("id") % 2000 / 50).alias("cited_id"))
        edges = graph.edges(cites, spark.range(50).select("id"), 4000)
        got = edges.select("src", "dst", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["src"], r["dst"]) for r in got) == [(s, d) for s in range(50) for d in range(40)]
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) == 40 and max(tasks.values()) <= 100


def test_dates_as_numbers(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("not-a-date",), (None,), ("99999-99-99",), ("1500-01-01",)], "x string")
    assert [r[0] for r in rows.select(scalars.yyyymmdd(F.col("x"))).collect()] == [20200101, 0, 0, 0, 0]


def test_cited_by_and_subtree(spark):
    opinions = spark.createDataFrame([(k, 10 if k == 1 else k, k == 4) for k in range(1, 6)], "id long, cluster_id long, blocked boolean")
    cites = spark.createDataFrame([(2, 1, 1), (3, 1, 3), (4, 1, 1), (5, 1, None), (2, 1, None)], "citing_id long, cited_id long, depth long")
    assert [tuple(r) for r in graph.cited_by(cites, opinions).collect()] == [(10, 2)]
    courts = spark.createDataFrame([("cal", None), ("calctapp", "cal"), ("ca9", None), ("a", "b"), ("b", "a")], "id string, parent_id string")
    assert {r["id"] for r in graph.subtree(courts, courts.where("id = 'cal'")).collect()} == {"cal", "calctapp"}
    assert {r["id"] for r in graph.subtree(courts, courts.where("id = 'a'")).collect()} == {"a", "b"}


def test_markup():
    page = 'The ferry <b>left</b> early. Compare <a href="/opinion/31/pier/">31 Harbor Rep. 9</a>, then <a class="q" href="/opinion/4410/lock#top"> Ostrander v. Lock Co.</a>. End.<script>var x;</script><!-- c -->'
    text, links = T.clean_markup(page)
    assert text == "The ferry left early. Compare 31 Harbor Rep. 9, then Ostrander v. Lock Co.. End."
    assert [(k["target"], text[k["start"] : k["end"]]) for k in links] == [("31", "31 Harbor Rep. 9"), ("4410", "Ostrander v. Lock Co.")]
    text, links = T.clean_markup('x <a href="/opinion/7/">one</a> and <a href="/opinion/7/">two</a><a href="/opinion/0/">z</a>')
    assert [text[k["start"] : k["end"]] for k in links] == ["one", "two"]
    assert T.clean_markup('<a href="/opinion/7/">A\x00B</a> c')[1] == [] and T.clean_markup(None) == ("", [])
    text, links = T.clean_markup('one<a href="/opinion/7/"> two </a>three &amp; four')
    assert text == "one two three & four" and text[links[0]["start"] : links[0]["end"]] == "two"


def test_cut_entities():
    """An entity that a cut has left without its semicolon is a character, or stays with ``whole``."""
    page = "<title>a &amp;&quot;&#65;&#x42; &amp</title> &ampx; &middot; &copy 5 &nosuch;"
    assert T.clean_markup(page)[0] == "a &\"AB & &x; · © 5 &nosuch;"
    assert T.clean_markup(page, whole=True)[0] == "a &\"AB &amp &ampx; · &copy 5 &nosuch;"


@pytest.mark.parametrize(
    "text,quote,found",
    [
        ("after rain the grey heron waits by the sluice gate", "the grey heron waits", True),
        ("Counsel wrote “all tolls—river \xa0tolls   too.”", "TOLLS–RIVER   tolls\ntoO.", True),
        ("the bylaw asks that every barge be inspected.", "[E]VERY barge be inspected.", True),
        ("the grey heron waits", "the grey stork waits", False),
        ("Tolls on the upper river are due each spring and are paid at the weir by barge owners.", "Tolls on the upper river … are paid at the weir by barge owners.", True),
        ("Tolls on the upper river are due each spring and are paid at the weir by barge owners.", "Tolls on the upper river [...] are paid at the weir by barge owners.", True),
        ("oak elm birch larch maple alder.", "oak elm ... larch poplar alder.", False),
        ("whatever", " ", False),
        ("the charter says never barge owners pay twice for one voyage", "barge owners pay twice for one voyage", False),
        ("the charter says never barge owners pay twice for one voyage", "never barge owners pay twice for one voyage", True),
        ("never may owners pay twice; some owners pay twice", "owners pay twice", True),
    ],
)
def test_quotes(text, quote, found):
    got = T.find_quote(text, quote)
    assert (got is not None) == found
    if got and got[0] == "exact":
        assert text[got[1] : got[2]] == quote


def test_patterns_are_made_where_their_letters_are():
    """No pattern is compiled for a text without the letters of a quote in a row; letters that only case-folding makes ASCII still match."""
    text = "The keeper noted that every toll\u00ad falls due in spring, \u2018they said\u2019."
    T._pattern.cache_clear()
    assert T.find_quote(text, "noted that wholly every toll falls due") is None and T.find_quote(text, "noted that toll falls ... in spring") is None
    assert T._pattern.cache_info().misses == 0
    assert T.find_quote(text, "EVERY  toll falls due in spring, 'they said'")[0] == "canonical" and T.find_quote(text, "noted [t]hat every ... due in spring")[0] == "elision"
    assert T.find_quote(text.replace("keeper", "\u212aeeper"), "the keeper noted")[0] == "canonical" and T.find_quote("toll", "\u00ad") is None


def test_spans():
    spans = T.quoted_spans("She wrote \"low tide at noon\" and “two barges\nran aground”. The miller's oxen' won't. 'lone quoted phrase now'.")
    assert [s["quote"] for s in spans] == ["low tide at noon", "two barges\nran aground", "lone quoted phrase now"]
    assert [s["quote"] for s in T.quoted_spans("\"wide outside 'some phrase kept inside' again\"")] == ["wide outside 'some phrase kept inside' again"]
    assert T.quoted_spans(None) == []


def test_citations():
    got = T.citations("Compare 31 Har. 204, 209; Id. at 211. Ostrander, 77 Har. at 18; Lock, supra, at 5. They sold 300 Rolls 18.")
    assert [(c["kind"], c["volume"], c["page"], c["pin"]) for c in got] == [("full", "31", "204", "209"), ("id", None, None, "211"), ("short", "77", None, "18"), ("supra", None, None, "5")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("By 33 U.S.C. § 408 tolls stop", [("usc", "33", "408")]),
        ("(46 C.F.R. § 15.705), then", [("ecfr", "46", "15.705")]),
        ("46 USC 2101.", [("usc", "46", "2101")]),
        ("33 U.S.C.A. §§ 1251a(b)(2)", [("usc", "33", "1251a")]),
        ("46 CFR§15.", [("ecfr", "46", "15")]),
        ("31 Har. 204; § 408; U.S.C. § 9; 33 U.S.C.; 1033 U.S.C. § 4; 33U.S.C. § 5; x U.S.C. § 5", []),
        ("33 U.S.C. § 408 and 33 U.S.C. § 409", [("usc", "33", "408"), ("usc", "33", "409")]),
        (None, []),
    ],
)
def test_statute_citations(text, want):
    got = T.statute_citations(text)
    assert [(s["source"], s["title"], s["section"]) for s in got] == want
    assert all(text[s["start"] :].startswith(s["title"]) and text[: s["end"]].endswith(s["section"]) for s in got)


def test_long_sections(spark):
    """A section's number is read whole: of seven digits it isn't the section of its first six."""
    assert [(s["title"], s["section"]) for s in T.statute_citations("1 U.S.C. § 1000050 and 46 CFR 12345678b.12")] == [("1", "1000050"), ("46", "12345678b.12")]
    codes = [(1, "usc", "1", "100005", "tolls", "all tolls end"), (2, "usc", "1", "1000050", "weirs", "all weirs stay")]
    statutes = spark.createDataFrame(codes, "id long, source string, title string, section string, heading string, text string")
    strings = spark.createDataFrame([], "cluster_id long, volume string, reporter string, page string")
    opinions = spark.createDataFrame([], "id long, cluster_id long, type string, blocked boolean, text string")
    asked = spark.createDataFrame([("1 U.S.C. § 1000050",), ("1 U.S.C. § 1000051",)], "asked string")
    assert {r["asked"]: r["heading"] for r in verify.lookup(asked, strings, opinions, statutes).collect()} == {"1 U.S.C. § 1000050": "weirs", "1 U.S.C. § 1000051": None}
    drafts = spark.createDataFrame([(1, 'Under 1 U.S.C. § 1000050 it is "all weirs stay" that counts.')], "draft_id long, text string")
    checks = verify.citation_checks(drafts, strings, opinions)
    assert [(r["statute_id"], r["status"]) for r in verify.quote_checks(drafts, checks, opinions, statutes=statutes).collect()] == [(2, "verified")]


def test_case_citations(spark):
    rows = [
        ("31 Har. 204", ("31", "Har.", "204")), (" 031  S. Ct.  007 ", ("31", "S. Ct.", "7")), ("31 204", None), ("31 9th 204", None), ("x Har. 204", None), ("12345 Har. 2", None),
        ("31 Har. 1234567", None), ("31 Har. II", None), ("31 Har§ 2", None), ("", None), (None, None),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", scalars.parsed_citation(F.col("t")).alias("c")).collect()
    assert {r["k"]: r["c"] and tuple(r["c"]) for r in got} == {k: w for k, (_, w) in enumerate(rows)}
    text = "Compare (31 Har. 204), 77 S. Ct. 18. They sold 300 Rolls 18 times; 31 Har. 204 again, 5 har. 6, 9 of Har. and 10 Sup. Ct. Rev. N. S. 11; 12 A. B. C. D. E. F. 13."
    one = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(scalars.inline_citations(F.col("t"))).collect()
    assert [r[0] for r in one] == [["31 Har. 204", "77 S. Ct. 18", "10 Sup. Ct. Rev. N. S. 11"], [], None]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "happy": "happi",
             "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "electrical": "electr", "revival": "reviv", "adoption": "adopt", "controlling": "control", "cease": "ceas", "sky": "sky"}
    assert {w: T.stem(w) for w in pairs} == pairs


def test_markup_stripping(spark):
    cases = {
        "# River\n- toll **due** and *paid* `now`\n\n\n\n7 * 9 and low_tide_line": "River\ntoll due and paid now\n\n7 * 9 and low_tide_line",
        "2) weir __shut__ _for now_ ***all***\n* one\n+ two": "weir shut for now all\none\ntwo",
        "open ** mark and 2 ** 3 ** 4 stay? a*b*c": "open ** mark and 2 ** 3 ** 4 stay? a*b*c",
        "plain": "plain",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", scalars.without_markup(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_calendar(spark):
    days = calendar.next_open_days(calendar.holidays(spark, 2019, 2027), "2020-12-01", "2026-12-31")
    got = {str(r["day"]): (r["is_open"], str(r["next_open"])) for r in days.collect()}
    assert got["2026-01-02"][0] and got["2026-01-01"] == (False, "2026-01-02") and got["2026-01-03"] == (False, "2026-01-05")
    assert got["2021-12-30"][1] == "2022-01-03" and not got["2021-12-31"][0]
    cases = [
        ([], "2026-01-01"), ([("2024-06-01", "2024-08-31")], "2026-04-03"), ([("2025-12-01", "2026-01-15")], "2026-02-16"), ([("2024-06-01", "2024-07-14"), ("2024-06-15", "2024-07-31")], "2026-03-03"),
        ([("2027-01-01", "2027-02-01")], "2026-01-01"), ([("2024-08-31", "2024-06-01"), (None, "2024-06-01")], "2026-01-01"), ([("2020-01-01", "2021-01-01")], "2026-01-01"),
        ([(f"2024-{m:02d}-01", f"2024-{m:02d}-10") for m in range(2, 12)], "2026-04-11"),
    ]
    rows = spark.createDataFrame([(k, [{"start": a, "end": b} for a, b in w]) for k, (w, _) in enumerate(cases)], "k int, w array<struct<start: string, end: string>>")
    windows = F.transform("w", lambda w: F.struct(F.to_date(w["start"]).alias("start"), F.to_date(w["end"]).alias("end")))
    got = rows.select("k", calendar.deadline(F.lit("2024-01-01").cast("date"), F.lit(2), windows).alias("due")).orderBy("k").collect()
    assert [str(r["due"]) for r in got] == [d for _, d in cases]
    assert str(spark.range(1).select(calendar.anniversary(F.lit("2024-02-29").cast("date"), F.lit(1))).first()[0]) == "2025-02-28"


def test_query_tokens():
    phrases = {"harbor dues", "general average loss"}
    assert search.query_tokens("The Harbor Dues and general average loss of a", phrases) == ["harbor dues", "general average loss"]
    assert search.query_tokens('");-- SELECT * OR') == ["select"] and search.query_tokens("") == []
    assert len(search.query_tokens("word " * 50)) == 24


def test_search(spark):
    texts = ["harbor dues meet general average here", "the harbor dues and general average again and again", "unrelated words entirely", "citing paper with none of them", "harbor alone"]
    opinions = spark.createDataFrame([(k + 1, k + 1, "x", "Published", False, False, t) for k, t in enumerate(texts)], "id long, cluster_id long, court_id string, status string, ocr boolean, blocked boolean, text string")
    cites = spark.createDataFrame([(4, 1, 1), (4, 2, 1)], "citing_id long, cited_id long, depth long")
    authority = spark.createDataFrame([(1, 0.5, 3)], "id long, pagerank double, recent long")
    parens = spark.createDataFrame([(3, 9, "found that harbor dues fall under general average")], "described_id long, describing_id long, text string")
    o = search.Options(limit=3, phrases=frozenset({"harbor dues", "general average"}))
    query = "harbor dues general average"
    c = search.collection(opinions, authority, parens, cites)
    got = {r["id"]: r["kind"] for r in search.search(query, c, o).collect()}
    assert got == {1: "organic", 2: "organic", 3: "seed"}
    o.prf, o.seed_slots = True, 0
    c = search.collection(opinions, authority, parens.limit(0), cites)
    rows = search.search(query, c, o).orderBy("place").collect()
    assert [(r["id"], r["kind"]) for r in rows] == [(1, "organic"), (2, "organic"), (4, "prf")]
    assert search.search("the of", c).count() == 0 and search.search("');-- SELECT * OR \"", c).count() == 0
    assert {r["id"] for r in search.near(c.index, ["harbor", "average"], 4).collect()} == {1, 2}
    # Stems: other forms of a word are found; a phrase needs its order.
    assert {r["id"] for r in search.search("citation averaged unrelatedly", c).collect()} == set()
    assert {r["id"] for r in search.ranked(c.index, ["citings", "papers"]).collect()} == {4}
    assert {r["id"] for r in search.ranked(c.index, ["dues harbor"]).collect()} == set() and {r["id"] for r in search.ranked(c.index, ["harbors due"]).collect()} == {1, 2}
    assert search.clamped(0) == 1 and search.clamped(1000) == 100
    assert [tuple(r) for r in search.search_relaxed("harbor zzz general dues", c, opinions, 1).select("way").distinct().collect()] == [("relaxed",)]


def test_blocks_are_skipped(spark, monkeypatch):
    """The best hits are the same with and without blocks skipped, for words and phrases, with filters; frequent terms' blocks are mostly skipped."""
    rng = random.Random(5)
    monkeypatch.setattr(search, "WIDTH", 8)
    words = ["barge", "heron", "sluice", "oxbow"] * 9 + ["weir", "toll"]
    docs = [(k, " ".join(["weir", "toll"] + [rng.choice(words) for _ in range(rng.randint(40, 60))])) for k in range(900)] + [(900 + k, "weir toll weir toll") for k in range(9)]
    index = search.build_index(spark.createDataFrame(docs, "id long, text string"))
    some = spark.createDataFrame([(k,) for k in range(0, 909, 3)], "id long")
    for tokens in (["weir", "toll"], ["weir toll"], ["weir", "heron"], ["weir", "toll barge"], ["absent", "toll"]):
        for allowed in (None, some):
            hits = search.ranked(index, tokens)
            hits = hits if allowed is None else hits.join(allowed, "id")
            want = [(r["id"], round(r["bm25"], 9)) for r in hits.orderBy(F.desc("bm25"), "id").limit(7).collect()]
            assert [(r["id"], round(r["bm25"], 9)) for r in search.top_ranked(index, tokens, 7, allowed).collect()] == want
    scorer = search.Scorer(index, ["weir", "toll"])
    needed = scorer.needed(7)
    assert needed is not None and needed.count() * 3 < scorer.bounds().count()
    monkeypatch.setattr(search, "BLOCKS_NAMED", 0)
    assert scorer.needed(7).count() == needed.count()
    assert search.build_index(spark.createDataFrame([], "id long, text string")).postings.count() == 0


def test_postings_of_a_batch(monkeypatch):
    """A task lists the stems of its texts itself, forms of one stem together and in order, whatever it lists at once."""
    import pyarrow as pa

    words = [["tolls", "due", "toll"], [], ["due"], ["Weir", "tolled", "tolls", "weir"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 3]), pa.array(words, pa.list_(pa.string()))], ["id", "words"])
    for most in (1, 3, 100):
        monkeypatch.setattr(search, "WORDS_AT_ONCE", most)
        got = [tuple(r.values()) for part in search._listed([batch.slice(0, 1), batch.slice(1)]) for r in part.to_pylist()]
        assert sorted(got) == [("Weir", 3, 4, [0]), ("due", 7, 3, [1]), ("due", 9, 1, [0]), ("toll", 3, 4, [1, 2]), ("toll", 7, 3, [0, 2]), ("weir", 3, 4, [3])]


def test_many_searches_at_once(spark, monkeypatch):
    """Only the best of each shard of texts leave a task, and they are those of single searches."""
    rng = random.Random(9)
    monkeypatch.setattr(search, "TEXTS_AT_ONCE", 25)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 2)
    words = ["barge", "heron", "sluice", "oxbow", "weir", "toll"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))) for k in range(120)]
    index = search.build_index(spark.createDataFrame(docs, "id long, text string"))
    asked = {1: ["heron", "toll"], 2: ["weir"], 3: ["weir", "absent"], 4: ["barge", "heron", "sluice", "oxbow"], 5: ["oxbow", "weir", "toll"]}
    some = spark.createDataFrame([(k,) for k in range(0, 120, 2)], "id long")
    wanted = spark.createDataFrame([(q, search.stems(t)[0]) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = search.ranked_batch(wanted, index, some, 4).collect()
    for q, tokens in asked.items():
        hits = search.ranked(index, tokens).join(some, "id").withColumn("bm25", F.round("bm25", 9)).orderBy(F.desc("bm25"), "id").limit(4).collect()
        assert [(r["id"], round(r["bm25"], 8)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["nth"])] == [(r["id"], round(r["bm25"], 8)) for r in hits]
    found = search.ranked_batch(wanted, index, some, 4, share=True).where("query_id = 2").orderBy("nth").collect()
    share = sorted((-round(t.split().count("weir") / len(t.split()), 9), k) for k, t in docs if k % 2 == 0 and "weir" in t)[:4]
    assert [(-r["share"], r["id"]) for r in found] == share


def test_parentheticals_and_passages_need_no_collection(spark, monkeypatch):
    from citeloom.plans import texts

    def never(c):
        raise AssertionError("the whole collection was asked for")

    monkeypatch.setattr(texts, "_collection", never)
    monkeypatch.setattr(texts, "_index", never)
    for name in ("a13_top_described", "f15_passages"):
        assert plans.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_filters(spark):
    courts = spark.createDataFrame([("har", "Harbor Court", None), ("har1", "First Pier", "har"), ("hill", "Hill Court", None)], "id string, name string, parent_id string")
    rows = [(k, k, ["har", "har1", "hill"][k % 3], "Published", False, False, "toll due", dt.date(2000 + k, 1, 1)) for k in range(9)] + [(20, 20, "har", "Unpublished", False, False, "toll due", dt.date(2001, 1, 1))]
    opinions = spark.createDataFrame(rows, "id long, cluster_id long, court_id string, status string, ocr boolean, blocked boolean, text string, date_filed date")
    none = spark.createDataFrame([], "id long, pagerank double, recent long")
    c = search.collection(opinions, none, spark.createDataFrame([], "described_id long, describing_id long, text string"), None, courts)
    ids = lambda **o: {r["id"] for r in search.search("toll", c, search.Options(**o)).collect()}
    assert ids() == set(range(9)) and ids(courts=frozenset({"hill"})) == {2, 5, 8} and ids(courts=frozenset()) == set()
    assert ids(jurisdiction="HAR") == {0, 1, 3, 4, 6, 7} and ids(jurisdiction="pier") == {1, 4, 7} and ids(jurisdiction="nowhere") == set(range(9))
    assert ids(jurisdiction="har", filed=("2003-01-01", "2006-01-01")) == {3, 4, 6} and ids(filed=(None, "2001-01-01")) == {0, 1}
    asked = spark.createDataFrame([(1, "tolls due"), (2, "the of"), (3, "toll absentword"), (4, None)], "query_id long, text string")
    got = search.search_batch(asked, c, search.Options(limit=4, courts=frozenset({"har", "hill"}))).collect()
    assert [(r["query_id"], r["place"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 1, 0), (1, 2, 2), (1, 3, 3), (1, 4, 5)]


def test_verification(spark):
    opinions = spark.createDataFrame([(1, 1, "020lead", False, "the clerk noted that every toll falls due in spring"), (2, 1, "040dissent", False, "another judge writes that barges sail free here"), (3, 2, "020lead", True, "x")], "id long, cluster_id long, type string, blocked boolean, text string")
    strings = spark.createDataFrame([(1, "31", "Har.", "204"), (2, "5", "F.2d", "7")], "cluster_id long, volume string, reporter string, page string")
    drafts = spark.createDataFrame(
        [(1, 'Held: "every toll falls due" 31 Har. 204.'), (2, 'Held: "judge writes that barges" 31 Har. 204.'), (3, 'Held: "herons own the upper weir" 31 Har. 204.'), (4, 'Held: "nobody is cited around here"'), (5, "See 999 Har. 1 and 5 F.2d 7."), (6, "plain")],
        "draft_id long, text string",
    )
    checks = verify.citation_checks(drafts, strings, opinions)
    assert {(r["draft_id"], r["volume"]): r["status"] for r in checks.collect()} == {(1, "31"): "verified", (2, "31"): "verified", (3, "31"): "verified", (5, "999"): "unresolved_citation", (5, "5"): "unresolved_citation"}
    quotes = verify.quote_checks(drafts, checks, opinions)
    assert {r["draft_id"]: r["status"] for r in quotes.collect()} == {1: "verified", 2: "within_cluster", 3: "not_found", 4: "unattributed"}
    assert {r["draft_id"]: r["overall"] for r in verify.report(drafts, checks, quotes).collect()} == {1: "verified", 2: "verified", 3: "failed", 4: "failed", 5: "failed", 6: "empty"}
    assert {(r["draft_id"], r["citation"]) for r in verify.export_gate(drafts, strings, opinions).collect()} == {(5, "999 Har. 1")}
    ranks = opinions.select("id", F.lit(False).alias("highest"), F.lit(0.0).alias("pagerank"))
    more = spark.createDataFrame([(9, 5, "020lead", False, "some believe that herons own the upper weir and lock", "Published")], "id long, cluster_id long, type string, blocked boolean, text string, status string")
    wide = opinions.withColumn("status", F.lit("Published")).unionByName(more)
    from citeloom.operators.search import build_index

    wrong = verify.quote_checks(drafts, checks, wide, build_index(wide.where("not blocked")), ranks)
    assert {r["draft_id"]: (r["status"], r["source_id"]) for r in wrong.collect()} == {1: ("verified", None), 2: ("within_cluster", None), 3: ("wrong_case", 9), 4: ("unattributed", None)}
    outside = spark.createDataFrame([(1, "As 2020 WL. 12345 shows."), (2, "Only 77 U.S.C. § 99999 says so."), (3, "By 33 U.S.C. § 408.")], "draft_id long, text string")
    code = spark.createDataFrame([("usc", "33", "408", "Taking of tolls")], "source string, title string, section string, heading string")
    told = verify.report(outside, verify.citation_checks(outside, strings, opinions), quotes.limit(0), verify.statute_checks(outside, code))
    assert {tuple(r) for r in told.select("draft_id", "n_citations", "overall", "summary").collect()} == {(1, 1, "verified", "citation:out_of_corpus=1"), (2, 1, "failed", "statute:unresolved_citation=1"), (3, 1, "verified", "statute:verified=1")}
    statutes = spark.createDataFrame([("usc", "33", "408", "Taking of tolls")], "source string, title string, section string, heading string")
    codes = spark.createDataFrame([(1, "By 33 U.S.C. § 408 and 33 U.S.C. § 409."), (2, "46 C.F.R. § 15.705")], "draft_id long, text string")
    found = verify.statute_checks(codes, statutes).collect()
    assert {(r["draft_id"], r["citation"], r["status"]) for r in found} == {(1, "33 U.S.C. § 408", "verified"), (1, "33 U.S.C. § 409", "unresolved_citation"), (2, "46 C.F.R. § 15.705", "unresolved_citation")}
    asked = spark.createDataFrame([("31 Har. 204",), ("33 U.S.C. § 408",), ("nothing",)], "asked string")
    assert {tuple(r) for r in verify.lookup(asked, strings, opinions, statutes).collect()} == {("31 Har. 204", "case", 1, None), ("33 U.S.C. § 408", "statute", None, "Taking of tolls"), ("nothing", None, None, None)}
    keys = spark.createDataFrame([("31", " Har. ", "204-205"), ("31", "Har.", "204")], "volume string, reporter string, page string")
    assert {r["id"] for r in verify.resolve(keys, strings, opinions).collect()} == {1}


def test_sharded_csv(spark, tmp_path):
    rng = random.Random(3)
    want = []
    lines = ["id,date,text\n"]
    for k in range(200):
        body = "".join(rng.choice(["a", "\n", ",", '\\"', "\\\\", "é", '\n\\"x\\",\\"y', "12"]) for _ in range(rng.randint(0, 30)))
        lines.append(f'"{k}","2020-01-01","{body}"\n')
        want.append((str(k), body.replace('\\"', '"').replace("\\\\", "\\")))
    lines.append('"200","2020-01-01","too","wide"\n')
    path = tmp_path / "rows.csv"
    path.write_bytes("".join(lines).encode())
    spark.dataSource.register(csv_shards.ShardedCsv)
    for size in (97, 1000, 1 << 20):
        rows = spark.read.format("sharded_csv").options(columns="id,date,text", shardBytes=size).load(str(path))
        got = [(r["id"], r["text"]) for r in rows.where("_reject is null").collect()]
        assert sorted(got) == sorted(want), size
        assert [tuple(r) for r in xml_sections.rejects(rows).collect()] == [("width 4 instead of 3", 1)]
    (tmp_path / "rows.csv.bz2").write_bytes(bz2.compress(path.read_bytes()))
    rows = spark.read.format("sharded_csv").options(columns="id,date,text").load(str(tmp_path / "rows.csv.bz2"))
    assert rows.where("_reject is null").count() == 200


def test_bz2_ranges(spark, tmp_path):
    """Several blocks, several streams, marks at all bits, lines that end with a block: every range size gives the whole once."""
    rng = random.Random(9)
    rows = [f'"{k}","2020-01-01","{"".join(rng.choice("abcdefgh\\n ") for _ in range(rng.randint(1, 3000)))}"\n' for k in range(400)]
    whole = "".join(rows).encode()
    cuts = [0, 100_000, len("".join(rows[:150]).encode()), 300_001, len(whole)]
    packed = b"".join(bz2.compress(whole[a:b], 1) for a, b in zip(cuts, cuts[1:]))
    (tmp_path / "x.bz2").write_bytes(packed)
    with open(tmp_path / "x.bz2", "rb") as f:
        found = list(bz2_blocks.blocks(f))
    assert b"".join(d for _, d in found) == whole and len(found) > 5 and len({bit % 8 for bit, _ in found}) > 2
    spark.dataSource.register(csv_shards.ShardedCsv)
    want = sorted(csv_shards.fields_of(r)[0::2] for r in rows)
    for size in (997, 40_000, 100_000, 1 << 20):
        read = spark.read.format("sharded_csv").options(columns="id,date,text", shardBytes=size).load(str(tmp_path / "x.bz2"))
        assert sorted([r["id"], r["text"]] for r in read.collect()) == want, size
    assert read.where("_reject is not null").count() == 0
    (tmp_path / "cut.bz2").write_bytes(packed[: len(packed) // 2])
    with open(tmp_path / "cut.bz2", "rb") as f, pytest.raises(EOFError):
        list(bz2_blocks.blocks(f))


def test_csv_errors(spark, tmp_path):
    """Columns by name in any order; reasons of rejects; a read ends after many records in a row that aren't aligned."""
    spark.dataSource.register(csv_shards.ShardedCsv)
    body = 'id,date,note,text\n"1","2020-01-01","n1","t1"\n"2","2020-01-01","n2"\n"3","2020-01-01","n3","' + "x" * 900 + '"\n"4","2020-01-01","n4","t4"\n'
    (tmp_path / "a").mkdir()
    for name in ("one.csv", "two.csv"):
        (tmp_path / "a" / name).write_text(body)
    read = spark.read.format("sharded_csv").options(columns="text,id", header=True, maxFieldChars=500, shardBytes=64).load(str(tmp_path / "a"))
    assert sorted((r["id"], r["text"]) for r in read.where("_reject is null").collect()) == [("1", "t1"), ("1", "t1"), ("4", "t4"), ("4", "t4")]
    assert {tuple(r) for r in xml_sections.rejects(read).collect()} == {("width 3 instead of 4", 2), ("quarantined: a field of 900 characters", 2)}
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("sharded_csv").options(columns="id,absent", header=True).load(str(tmp_path / "a")).count()
    # The first field isn't the number that the line begins with: it goes on behind the quotes.
    (tmp_path / "shifted.csv").write_text("".join(f'"{k}","2020-01-01","t"\n' for k in range(9)) + '"9","2020-01-01","t"\n' + "".join(f'"{k}","2020-01-01","t\n' for k in range(40)))
    read = spark.read.format("sharded_csv").options(columns="id,date,text", maxMisaligned=0).load(str(tmp_path / "shifted.csv"))
    assert read.where("_reject is null").count() > 9
    reader = csv_shards.Reader(read.schema, {"path": "x", "maxMisaligned": 5})
    found = [(["x", "d", "t"], k, None) for k in range(5)] + [(["5", "d", "t"], 5, None)] + [(["x", "d", "t"], k, None) for k in range(6)]
    part = csv_shards.Range("x", 0, 9)
    assert [r[-1] for r in reader._rows(iter(found[:-1]), part)] == ["misaligned"] * 5 + [None] + ["misaligned"] * 5
    with pytest.raises(ValueError, match="in a row"):
        list(reader._rows(iter(found), part))


def test_xml_sections(spark, tmp_path):
    regulation = b'<R><DIV8 TYPE="SECTION" N="1026.36"><HEAD>Rule.</HEAD><P>(a) <I>Def.</I> rest</P><NOTE><P>noted once</P></NOTE></DIV8><DIV8 TYPE="SECTION"><HEAD>none</HEAD></DIV8></R>'
    code = b'<d xmlns="urn:x"><section identifier="sec_1983"><heading>Civil</heading><level><content>Body</content></level><note><P>Pub. L. 107</P></note></section><section><num value="1985a"/><heading>H</heading><effective_date>Jan. 6, 1997</effective_date></section></d>'
    (tmp_path / "reg").mkdir()
    (tmp_path / "code").mkdir()
    (tmp_path / "reg/a.xml").write_bytes(regulation)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.txt", "no")
        z.writestr("b.xml", code)
    (tmp_path / "code/b.zip").write_bytes(packed.getvalue())
    got = xml_sections.sections(spark, str(tmp_path / "reg"), "regulation").collect()
    assert [(r["section"], r["heading"], r["text"], r["error"]) for r in got] == [("1026.36", "Rule.", "(a) Def. rest noted once", None)]
    (tmp_path / "reg/bad.xml").write_bytes(b"<R><open>")
    (tmp_path / "reg/typed.xml").write_bytes(b"<!DOCTYPE x><a/>")
    errors = {r["path"].rpartition("/")[2]: r["error"] for r in xml_sections.sections(spark, str(tmp_path / "reg"), "regulation").collect()}
    assert errors["a.xml"] is None and errors["bad.xml"].startswith("ParseError") and errors["typed.xml"].startswith("ValueError")
    rows = xml_sections.sections(spark, str(tmp_path / "code"), "code").where("error is null").drop("path")
    assert {(r["section"], r["text"], r["effective_date"]) for r in rows.collect()} == {("1983", "Body Pub. L. 107", None), ("1985a", "", "Jan. 6, 1997")}
    fresh = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate([("1983", "old"), ("1983", "new"), ("9", "x")])], "section string, text string, n int")
    known = fresh.where("n = 0").withColumn("text", F.lit("before")).union(spark.createDataFrame([("7", "stays", 0)], fresh.schema))
    merged = xml_sections.upsert(known, fresh, ["section"], "n")
    assert {(r["section"], r["text"]) for r in merged.collect()} == {("1983", "new"), ("9", "x"), ("7", "stays")}
    with pytest.raises(ValueError):
        xml_sections.document(b"<!DOCTYPE x><a/>")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").writestr("x.txt", "no")


def test_streaming(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(minutes=20 * k), k % 2, "view", 1.0, "{}") for k in range(60)]
    spark.createDataFrame(rows, audit.SCHEMA).write.parquet(str(tmp_path / "log"))
    log = audit.read_log(spark, str(tmp_path / "log"))
    audit.append(log, str(tmp_path / "copy"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 60
    audit.append(audit.hourly(log), str(tmp_path / "hours"), str(tmp_path / "c2")).awaitTermination()
    got = spark.read.schema("hour timestamp, event_type string, n long, total double").parquet(str(tmp_path / "hours"))
    assert got.count() > 10 and {r["n"] for r in got.collect()} == {3}
    assert audit.runs(log).isStreaming


def test_stale_runs(spark, tmp_path):
    """Runs swept by timers are the batch's, but for those still open, in whatever pieces the log comes."""
    rng = random.Random(4)
    at, rows = dt.datetime(2024, 1, 1), []
    for k in range(600):
        at += dt.timedelta(minutes=rng.choice([1, 5, 9, 40, 61, 200]))
        rows.append((k, at, rng.randrange(5) if k % 50 else None, rng.choice(["view", "cart"]), 1.0, "{}"))
    table = spark.createDataFrame(rows, audit.SCHEMA)
    for k in range(6):
        table.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(str(tmp_path / "log"), mode="append")
        time.sleep(0.05)
    log = audit.read_log(spark, str(tmp_path / "log"), files_at_once=1)
    audit.append(audit.stale_runs(log), str(tmp_path / "runs"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(audit.RUN).parquet(str(tmp_path / "runs")).collect()}
    whole = {tuple(r) for r in audit.ended_runs(table).select("user_id", "begun", "last", "n", "last_type").collect()}
    open_ = {r for r in whole if r[2] + dt.timedelta(hours=3) >= rows[-1][1]}
    assert got <= whole and whole - got <= open_ and len(got) > 50


def test_small_text_helpers(spark):
    rows = spark.createDataFrame([('He came. "She" left! Was it so? yes it was.', "LAW", "Finding that 31 Har. 204 the toll lapsed Id.")], "t string, tag string, q string")
    got = rows.select(scalars.sentences(F.col("t")), scalars.known_tag(F.col("tag")), scalars.known_tag(F.col("q")), scalars.cleaned_query(F.col("q"))).first()
    assert got[0] == ["He came.", '"She" left!', "Was it so? yes it was."] and got[1] == "LAW" and got[2] is None and got[3] == "the toll lapsed"
    assert search.relaxed(["harbor dues", "tax", "weir", "lighterage", "demurrage"]) == ["harbor dues", "lighterage", "demurrage"]
    words = spark.createDataFrame([("Every barge shall be inspected for leaks, ballast, or rot before the first voyage of spring",)], "q string").select(scalars.probe_words(F.col("q")).alias("w"))
    assert words.select(scalars.longest(F.col("w"), 2)).first()[0] == ["inspected", "ballast,"]
    assert words.select(F.size(scalars.middle(F.col("w")))).first()[0] == 10
    texts = spark.createDataFrame([(1, "toll toll toll"), (2, "toll " + "x" * 900 + " toll")], "id long, text string")
    dense = search.by_density(texts.select("id", F.lit(1.0).alias("final")), texts, ["toll"])
    best = {r["id"]: r["hits"] for r in dense.collect()}
    assert best == {1: 3, 2: 1}


def test_mutations_and_rates(spark):
    """Changes are made where there is something to change, and the verifier strikes all of them but none of the quotes."""
    rows = [(1, "In spring Alder pays 40 tolls at the weir for two barges"), (2, "low tide"), (3, "same same same same")]
    made = {r["id"]: r["m"] for r in spark.createDataFrame(rows, "id long, quote string").select("id", evaluate.mutated(F.col("quote"), F.col("id")).alias("m")).collect()}
    assert made[1] == {
        "none": rows[0][1], "word": "In spring wholly pays 40 tolls at the weir for two barges", "number": "In spring Alder pays 50 tolls at the weir for two barges",
        "name": "In spring Roe pays 40 tolls at the weir for two barges", "negation": "In spring Alder not pays 40 tolls at the weir for two barges", "order": "In spring pays Alder 40 tolls at the weir for two barges",
    }
    assert {k: v for k, v in made[2].items() if v} == {"none": "low tide"} and made[3]["order"] is None and made[3]["negation"] == "same same same not same"
    texts = spark.createDataFrame([(k, f"It is told: {t}. Nothing else.", t) for k, t in rows[:2]] + [(9, "they never pay two tolls here", "pay two tolls here")], "id long, text string, quote string")
    rates = {r["kind"]: (r["n"], r["caught"]) for r in evaluate.catch_rates(evaluate.caught(texts)).collect()}
    assert rates["none"] == (3, 1) and rates["number"] == (1, 1) and rates["word"] == (2, 2) and rates["order"] == (2, 2)
    assert [tuple(r) for r in evaluate.caught(texts).where("signature is not null").select("id", "kind", "signature").collect()] == [(9, "none", "struck")]
    assert evaluate.caught(texts.limit(0)).count() == 0


def test_rankings(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31), (3, 31)], "query_id long, cluster_id long")
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 9), (2, 2, 20), (3, 1, 30), (3, 2, 31), (7, 1, 1)], "query_id long, place int, cluster_id long")
    b = spark.createDataFrame([(1, 1, 4), (2, 1, 20), (3, 3, 30)], "query_id long, place int, cluster_id long")
    runs = [evaluate.precision(x, truth, 2) for x in (a, b)]
    assert sorted(tuple(r) for r in runs[0].collect()) == [(1, 1, 1, 1, 0.5), (2, 1, 1, 2, 0.5), (3, 2, 2, 1, 1.0)]
    assert tuple(evaluate.against_baseline(runs[1], runs[0]).first()) == (3, 0.166667, 0.666667, -0.5, False)
    kinds = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "query_id long, kind string")
    assert sorted(tuple(r) for r in evaluate.compared(*runs, kinds).collect()) == [("x", 1, 1, 0, 0, 1, "cut"), ("y", 2, 1, 1, 1, 1, "keep")]


def test_antecedents(spark):
    """Short, id and supra forms stand for their full citation; an id for what the one before does, or for nothing."""
    opinions = spark.createDataFrame([(1, 1, "020lead", False), (2, 2, "020lead", False), (3, 3, "020lead", False)], "id long, cluster_id long, type string, blocked boolean")
    strings = spark.createDataFrame([(1, "31", "Har.", "204"), (2, "77", "Har.", "9"), (3, "77", "Har.", "9")], "cluster_id long, volume string, reporter string, page string")
    texts = [
        (1, "Alder v. Birch, 31 Har. 204, 209, came first; Ostrander v. Lock, 77 Har. 9. Id. at 11. Id. Alder, supra, at 3. Id. at 4. 31 Har. at 206. See § 12. Id."),
        (2, "Id. at 3; Cedar, supra; 5 Har. at 6."),
        (3, "bad \x00 text"),
    ]
    checks = verify.citation_checks(spark.createDataFrame(texts, "draft_id long, text string"), strings, opinions, spark.createDataFrame([(2, 5)], "id long, flags int"))
    got = sorted((r["idx"], r["kind"], r["full_idx"]) for r in verify.antecedents(checks).where("draft_id = 1").collect())
    assert got == [(0, "full", 0), (1, "full", 1), (2, "id", 1), (3, "id", 1), (4, "supra", 0), (5, "id", 0), (6, "short", 0), (7, "unknown", None), (8, "id", None)]
    assert {(r["kind"], r["full_idx"]) for r in verify.antecedents(checks).where("draft_id = 2").collect()} == {("id", None), ("supra", None), ("short", None)}
    told = {r["idx"]: r for r in checks.where("draft_id = 1 and kind = 'full'").collect()}
    assert (told[0]["corrected"], told[0]["ambiguous"], told[0]["pin_unverified"], told[0]["treatment"]) == ("31 Har. 204", False, True, [])
    assert (told[1]["ambiguous"], told[1]["pin_unverified"], told[1]["treatment"]) == (True, False, ["overruled", "distinguished"])
    assert [(r["kind"], r["status"], r["error"]) for r in checks.where("draft_id = 3").collect()] == [("error", "unresolved_citation", "ValueError: NUL in a text")]


def test_sentence_verdicts(spark):
    """Checks belong to the sentence that they lie in; LAW needs a pin that is a citation."""
    rows = [(1, 0, "LAW", "Tolls end", "31 Har. 204"), (1, 1, "RECORD", "He said it", None), (1, 2, "LAW", "No pin", None), (1, 3, "LAW", "Bare", "26065"), (2, 0, "INFERRED", "", None)]
    sentences = spark.createDataFrame(rows, "draft_id long, n int, tag string, text string, pin string")
    text = {r["draft_id"]: r["text"] for r in verify.drafted(sentences).collect()}
    assert text == {1: "[LAW] Tolls end (31 Har. 204) [RECORD] He said it [LAW] No pin [LAW] Bare (26065)", 2: "[INFERRED] "}
    at = text[1].index("31 Har")
    checks = spark.createDataFrame([(1, at, at + 11, "verified"), (1, 2, 4, "unresolved_citation"), (1, at + 5, at + 30, "unresolved_citation")], "draft_id long, start int, end int, status string")
    quotes = spark.createDataFrame([(1, text[1].index("He"), text[1].index("He") + 4, "not_found")], "draft_id long, start int, end int, status string")
    got = {(r["draft_id"], r["n"]): (r["n_cites"], r["n_quotes"], r["reason"]) for r in verify.sentence_verdicts(sentences, checks, quotes).collect()}
    assert got == {(1, 0): (1, 0, None), (1, 1): (0, 1, "quote:not_found"), (1, 2): (0, 0, "no pin"), (1, 3): (0, 0, "pin without citation"), (2, 0): (0, 0, None)}


def test_paragraphs_keep_their_digits(spark, tmp_path):
    """Only blanks are trimmed from paragraphs, not the digits of their places."""
    texts = [(0, " 10 barges 0\n1 toll 1 \n\n 2 weirs 22"), (1, None), (2, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in plans.queries()["x32_paragraphs"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, "10 barges 0"), (0, 1, "1 toll 1"), (0, 2, "2 weirs 22")]


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    """Where the session's partitions would be too large, pairs go to as many tasks as they need; the edges are the same."""
    nodes = spark.range(40)
    cites = spark.range(900).select((F.col("id") * 7 % 43).alias("citing_id"), (F.col("id") % 41).alias("cited_id"))
    plain = graph.edges(cites, nodes)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 50)
    dealt = graph.edges(cites, nodes, 900)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and "18)" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_rows_of_a_batch_pass_in_pieces(spark, monkeypatch):
    """A function of values sees a few rows of an Arrow batch at a time, and what it gives leaves before the next are read."""
    import pyarrow as pa

    seen = []
    with monkeypatch.context() as m:
        m.setattr(T.F, "arrow_udf", lambda run, result: lambda *columns: run)
        run = T._rows("n int", ["n"], lambda v: (seen.append(v) or len(v),), F.lit("x"))
    out = run(iter([pa.array(["ab"] * 1000), pa.array([], "string")]))
    assert len(next(out)) == len(seen) == T.ROWS_AT_ONCE < 1000
    assert sum(len(x) for x in out) == 1000 - T.ROWS_AT_ONCE
    pages = spark.range(1000).repartition(1).select("id", F.concat(F.lit('<a href="/p'), "id", F.lit('">t</a>'), F.when(F.col("id") % 7 == 0, None).otherwise("")).alias("html"))
    links = {r["id"]: [x["target"] for x in r["x"]["links"]] for r in pages.select("id", T.clean_markup_of(F.col("html"), T.PATH_LINK).alias("x")).collect()}
    assert links == {k: [f"p{k}"] if k % 7 else [] for k in range(1000)}


def test_blocks_are_summed_without_a_shuffle(spark):
    """Runs of postings give what an aggregate of the blocks gives; a block that a batch cuts has two rows."""
    rows = [(t, b, 1 + (t + b) % 5, 40 + b) for t in range(30) for b in range(20) for _ in range(1 + t % 3)]
    postings = spark.createDataFrame(rows, "term int, block long, tf int, size int").withColumn("term", F.concat(F.lit("t"), "term")).coalesce(1)
    runs = postings.mapInArrow(search._blocks(50.0), "term string, block long, n long, cf long, top double")
    merged = runs.groupBy("term", "block").agg(F.sum("n").alias("n"), F.sum("cf").alias("cf"), F.round(F.max("top"), 9).alias("top"))
    want = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.sum("tf").alias("cf"), F.round(F.max(search.impact(F.col("tf"), F.col("size"), 50.0)), 9).alias("top"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))
    index = search.build_index(spark.createDataFrame([(k, "weir toll " * (k % 4 + 1)) for k in range(300)], "id long, text string"))
    assert {tuple(r) for r in index.stats.collect()} == {(T.stem("weir"), 300, 750), (T.stem("toll"), 300, 750)}


def test_what_has_a_quote_has_its_prints(monkeypatch):
    """whatever the form in which a text has a quote, it has the quote's fingerprints, in parts too."""
    rng = random.Random(5)
    words = ["alpha", "weir's", "tolls", "Kelvin", "éclair", "日本", "im", "SSS", "co-op", "[b]eta", "a", "…", "x1", "“so”", "straße", "İk", "­­­­"]
    found = 0
    for _ in range(3000):
        quote = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        own = re.sub(r"\[([A-Za-z]+)\]", r"\1", quote) if rng.random() < 0.5 else quote
        own = own.replace("…", rng.choice(["…", "and so on", " "])).upper() if rng.random() < 0.6 else own
        own = own.replace("S", rng.choice("Sſ")).replace("K", rng.choice("KK")).replace("'", rng.choice("'’")).replace("I", rng.choice("Iıİ")).replace(" ", rng.choice([" ", " \n", "­ "])).replace("-", rng.choice("-–"))
        text = "".join(rng.choice("abc xyz") for _ in range(rng.randint(0, 40))) + own + " end"
        if not T.find_quote(text, quote):
            continue
        found += 1
        data = T.essential(quote).encode()
        kind = prints.kind_of(len(data))
        marked = np.full(16, -1).view(np.uint64)
        for at_once in (7, 1 << 18):
            monkeypatch.setattr(prints, "CHARS_AT_ONCE", at_once)
            assert set(prints.prints(data, kind).tolist()) <= set(prints._some(text, [kind], marked).tolist())
    assert found > 1000


def test_true_source_behind_many_likely_texts(spark):
    """a quote's source is found however many texts have a larger share of its words, and of many sources the best by rank."""
    said = "the herons of the upper weir own every lock and toll by custom"
    turned = " ".join(reversed(said.split()))
    rows = [(k, k, "020lead", False, turned, "Published") for k in range(10, 210)] + [(300, 300, "020lead", False, "barges sail on " * 400 + said + " they say", "Published")]
    rows += [(k, k, "020lead", False, f"{k} tides turn where the old mill stands by the harbour wall, it is told", "Published") for k in range(400, 500)]
    rows += [(k, k, "020lead", False, f"{k} tides turn where the old mill stood by the harbour wall, it is told", "Published") for k in range(500, 800)]
    rows += [(1, 1, "020lead", False, "nothing", "Published"), (2, 2, "020lead", True, "a blocked text with words of its own", "Published")]
    opinions = spark.createDataFrame(rows, "id long, cluster_id long, type string, blocked boolean, text string, status string")
    strings = spark.createDataFrame([(1, "31", "Har.", "204")], "cluster_id long, volume string, reporter string, page string")
    quotes = [said, "where the old mill stands by the harbour wall", "where the old mill stood by the harbour wall, it is", "where the old mill stands by the harbour gate", "a blocked text with words of its own", "it is told"]
    drafts = spark.createDataFrame([(k, f'Held: "{q}" 31 Har. 204.') for k, q in enumerate(quotes)], "draft_id long, text string")
    ranks = opinions.select("id", (F.col("id") == 460).alias("highest"), F.when(F.col("id") > 500, 1.0 / F.col("id")).alias("pagerank"))
    got = verify.quote_checks(drafts, verify.citation_checks(drafts, strings, opinions), opinions, ranks=ranks)
    assert {r["draft_id"]: (r["status"], r["source_id"]) for r in got.collect()} == {0: ("wrong_case", 300), 1: ("wrong_case", 460), 2: ("wrong_case", 501), 3: ("not_found", None), 4: ("not_found", None), 5: ("wrong_case", 460)}
    known, held = verify.holders(drafts.select(F.lit(said).alias("quote")), opinions.select("id", "text"))
    last = known.withColumn("print", F.lit(7).cast("long"))
    many = spark.createDataFrame([(7, k) for k in [*range(10, 210), 300]], "print long, id long")
    assert [r["source_id"] for r in verify.true_sources(last, many, opinions.select("id", "text"), ranks, 2).collect()] == [300] and held.count() == 1


def test_passages_count_all_hits():
    """F8: the densest window is that of all occurrences, however many come before it; a limit holds only where it is given."""
    text = "nation stands. " + "tion far away from here, " * 250 + "tiontion " * 40
    got, first = T.passage(text, ["tion"]), T.passage(text, ["tion"], most_hits=200)
    places = [m.start() for m in re.finditer("tion", text)]
    n = [sum(p <= q < p + 600 for q in places) for p in places]
    assert got["hits"] == max(n) > first["hits"] == max(sum(p <= q < p + 600 for q in places[:200]) for p in places[:200])
    assert got["start"] == places[n.index(max(n))] - 150 + (len(text[places[n.index(max(n))] - 150 :]) - len(text[places[n.index(max(n))] - 150 :].lstrip()))
    assert T.passage("no such word", ["tion"])["hits"] == 0 and T.passage(None, ["tion"]) == {"passage": "", "start": 0, "end": 0, "hits": 0}
    assert T.passage("a b a", ["a", "b"])["hits"] == 3 and "least(n, 200)" not in plans.oracle_sql()["f15_passages"]


def test_rows_of_many_searches_dont_grow_with_shards(spark, monkeypatch):
    """what can't be among the best of all shards isn't written, and the best are the same."""
    rng = random.Random(4)
    docs = [(k, " ".join(["weir"] * rng.randint(1, 30) + ["toll"] * rng.randint(1, 30) + (["rare"] if k < 9 else []))) for k in range(600)]
    index = search.build_index(spark.createDataFrame(docs, "id long, text string"))
    wanted = spark.createDataFrame([(1, "weir"), (2, "weir"), (2, "toll"), (3, "rare")], "query_id long, term string")
    some = spark.createDataFrame([(k,) for k, _ in docs], "id long")
    sizes, write = [], search.written

    def counted(df, name, *more):
        table = write(df, name, *more)
        sizes.extend([table.count()] if name == "found" else [])
        return table

    monkeypatch.setattr(search, "written", counted)
    got = []
    for texts in (1000, 30):
        monkeypatch.setattr(search, "TEXTS_AT_ONCE", texts)
        got.append(sorted(tuple(r) for r in search.ranked_batch(wanted, index, some, 40).collect()))
    assert got[0] == got[1] and len(got[0]) == 89 and sizes[0] == 89 and sizes[1] < 600  # 1,209 if every shard gave its best
