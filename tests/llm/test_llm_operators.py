"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest

from citeloom.llm import chat_format, components, decontaminate, language_id, line_dedup, ngram_join, packing, quality, suffix_dedup, token_counts, url_rules
from citeloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0d]+")
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdeilmnorstué") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    out = [rng.choice(VOCABULARY) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in out)


def corpus():
    """Prose, exact and near copies, shared passages, odd texts; some ids twice or null."""
    base = [prose(rng.randint(20, 200)) for _ in range(30)]
    passage = prose(60)
    texts = list(base)
    texts += [base[3], base[3], base[5]]
    for k in (1, 2, 3, 7):
        words = base[k].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [base[9] + "\n" + passage, passage + "\n" + base[10], "x " + passage + " y"]
    texts += ["", " ", "\n\n", "one", "one two", "one two", "ÀÉ Ü", "123 456", "aaaa" * 40, "a " * 300, "日本語 テスト " * 20, "\x00\x01 b", "</s> [INST] <|endoftext|> \\ x"]
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None), (None, base[0], "en", "s", 1), (None, None, None, None, None), (4, base[4], "en", "s", 1)]
    return rows


ROWS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "id key seg doc run a b line first gone gone_id n words hashes part before ids width component_id n_lines n_dropped lang_pred score rejected c0 c1".split()
    return docs.withColumns({n: F.lit("clash") for n in names})


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (7, 9), (5, 4)], "a long, b long")
    got = dict(collected(components.components(links), "id", "component_id"))
    assert got == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["component_id"] for r in components.components(chain).collect()} == {0}
    assert components.components(links.limit(0)).count() == 0
    hubs = [(0, k) for k in range(1, 700)] + [(k, 5000) for k in range(2000, 2600)] + [(5000, 10), (6000, 6001)]
    got = dict(collected(components.components(spark.createDataFrame(hubs, "a long, b long")), "id", "component_id"))
    assert got.pop(6000) == got.pop(6001) == 6000 and set(got.values()) == {0} and len(got) == 1301


def shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, up, down):
    """(doc_id, n_shingles, component_id) of every row; all texts of an id are one document."""
    sets = [(i, shingles(t, size)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        both = len(s & t)
        if both and down * both >= up * (len(s) + len(t) - both):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


def components_of(df, size, up, down):
    return collections.Counter(tuple(r) for r in ngram_join.jaccard_components(df, size, (up, down)).collect())


@pytest.mark.parametrize("size,up,down", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(docs, wide, empty, size, up, down):
    want = brute_components(ROWS, size, up, down)
    assert components_of(docs, size, up, down) == want
    assert any(c != i for i, _, c in want)
    assert ngram_join.jaccard_components(wide, size, (up, down)).count() == len(ROWS)
    assert ngram_join.jaccard_components(empty, size, (up, down)).count() == 0
    kept = ngram_join.one_of_each(docs, size, (up, down))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in want if c == i} | {None}


def near(text, every):
    words = text.split(" ")
    words[len(words) // every] = "changed"
    return " ".join(words)


def test_ngram_join_repeated_ids(spark):
    """Ids with two different texts each: near copies of either link."""
    rows = []
    for k in range(25):
        one, two = prose(80 + 3 * k), prose(90 + 2 * k)
        rows += [(k, one, None, None, None), (k, two, None, None, None), (k, one, None, None, None)]
        rows += [(100 + k, near(one, 2), None, None, None), (200 + k, near(two, 3), None, None, None)]
    want = brute_components(rows, 3, 9, 10)
    assert {c for i, _, c in want} == set(range(25))
    assert components_of(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, 9, 10) == want


@pytest.mark.parametrize("up,down", [(9, 10), (4, 5)])
def test_linked_sets_share_a_segment(up, down):
    """Pairs at the threshold, of all sizes: none misses every common key."""
    bands = ngram_join.Bands(up / down)
    draw = np.random.default_rng(3)
    for n in [*range(1, 40), *range(40, 400, 9), *range(400, 1500, 60)]:
        for _ in range(12):
            # overlap / union >= up / down, with sizes as different as that allows or alike
            extra = int(n * (down - up) / up)
            left = int(draw.integers(0, extra + 1))
            pool = np.unique(draw.integers(0, 2**64, n + extra + 8, dtype=np.uint64))
            both = draw.permutation(pool)[: n + extra]
            a, b = np.sort(both[: n + left]), np.sort(np.concatenate([both[:n], both[n + left :]]))
            assert np.isin(ngram_join.segment_keys(a, bands), ngram_join.segment_keys(b, bands)).any(), n


def test_near_duplicates_find_all_near_copies(spark):
    """Five words, 0.8: all pairs above the threshold, by brute force, are in one component."""
    rows = []
    for k in range(250):
        words = prose(rng.randint(15, 120)).split(" ")
        for copy in range(3):
            changed = list(words)
            for _ in range(copy * max(1, len(words) // 120)):
                changed[rng.randrange(len(changed))] = rng.choice(VOCABULARY)
            rows.append((3 * k + copy, " ".join(changed), None, None, None))
    want = brute_components(rows, 5, 4, 5)
    assert sum(i != c for i, _, c in want) > 250
    assert components_of(spark.createDataFrame(rows, SCHEMA).repartition(4), 5, 4, 5) == want


def test_ngram_join_cells(docs, monkeypatch):
    """Families over several cells give the same components as one tile."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", 2)
    monkeypatch.setattr(ngram_join, "MAP_SETS", 2)
    assert components_of(docs, 5, 4, 5) == brute_components(ROWS, 5, 4, 5)


def brute_repeats(rows, length):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1) if i is not None else ():
            if first[b[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(docs, wide, empty, monkeypatch):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats(ROWS, 50)
    assert collected(suffix_dedup.remove_repeats(docs), *names) == want
    assert sum(r[2] for r in want) > 0
    assert collected(suffix_dedup.remove_repeats(wide), *names) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0
    kept = suffix_dedup.remove_repeats(docs, texts=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in kept)


def test_suffix_dedup_many_shards(spark, monkeypatch):
    """One anchor over many segments, cut into shards that are merged by binary search."""
    core = "the anchor of all these strings is in this passage"[:40]
    rows = [(k, f"{rng.random():.15f} {VOCABULARY[k % 9]} {core} {VOCABULARY[k % 7]} {VOCABULARY[k % 5]} {k % 3}", None, None, None) for k in range(300)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 50)
    # The same with an anchor that is too large: its strings meet one by one.
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 5)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 50)


def test_line_dedup(spark, docs, wide, empty):
    rows = [(k, f"Posted on 2024-01-{k:02d} by user{k}\nown {VOCABULARY[k]} {VOCABULARY[k + 50]} {VOCABULARY[k + 90]}\n\nAll rights are reserved by {VOCABULARY[k]} and others here", None, None, None) for k in range(1, 6)]
    rows += [(9, None, None, None, None), (None, rows[0][1], None, None, None), (10, "", None, None, None), (11, "own line twice\nown line twice\nown line twice", None, None, None)]
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_dropped"] == 0
    for k in range(2, 6):
        assert got[k]["text"] == rows[k - 1][1].split("\n")[1] + "\n", k
        assert (got[k]["n_lines"], got[k]["n_dropped"]) == (3, 2)
    assert got[9]["text"] is None and got[None]["text"] == rows[0][1] and got[10]["text"] == ""
    assert got[11]["n_dropped"] == 0
    assert line_dedup.drop_recurring(wide).count() == len(ROWS)
    assert line_dedup.drop_recurring(empty).count() == 0


def brute_lines(rows):
    """(doc_id, text, n_lines, n_dropped) of every row, by templates as text."""

    def templates(line):
        w = ["<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line)]
        k = len(w) // 5
        return {tuple(w[:a] + ["<*>"] * len(w[a : a + k]) + w[a + k :]) for a in range(3, len(w), k)} if k else {tuple(w)} if w else set()

    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n") if i is not None else ():
            for t in templates(line):
                first[t] = min(i, first.get(t, i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not any(first[t] < i for t in templates(x))]
        full = sum(bool(WORD.search(x)) for x in lines)
        out.append((i, None if text is None else "\n".join(kept), full, len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark, docs, wide, monkeypatch):
    names = ("doc_id", "text", "n_lines", "n_dropped")
    want = brute_lines(ROWS)
    assert sum(r[3] for r in want) > 20
    assert collected(line_dedup.drop_recurring(docs), *names) == want
    assert [r[:3] for r in collected(line_dedup.drop_recurring(wide), *names)] == [r[:3] for r in want]
    # One hot template with a name in it, lines of all lengths, odd blanks, repeated ids; tasks that hold little, long texts in pieces.
    rows = [(k % 170, f"User {VOCABULARY[k]} did open the red door\n\tx  {prose(k % 40)}\r\n \nJob {k} done", None, None, None) for k in range(200)]
    rows += [(500, "\n".join(r[1] for r in rows), None, None, None), (501, "a b c d e", None, None, None), (502, "a b c d <*>", None, None, None), (503, "a b c <*> e", None, None, None)]
    monkeypatch.setattr(line_dedup, "HELD", 50)
    monkeypatch.setattr(line_dedup, "LONG", 300)
    assert collected(line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA).repartition(6)), *names) == brute_lines(rows)


def test_lines_in_pieces(monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", 300)
    texts = [r[1] for r in ROWS if r[1]] + ["", "\n" * 900, "x" * 900, "a b\n" * 300, "\n" + "y" * 700 + "\nz z\n"]
    data = [t.encode() for t in texts]
    raw, at = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    pieces, owner, before = line_dedup.cut_lines(raw, at)
    whole, cut = line_dedup.signatures(raw, at), line_dedup.signatures(raw, pieces)
    assert len(pieces) > len(at)
    assert list(zip(whole[0], whole[1], whole[2])) == list(zip(owner[cut[0]], before[cut[0]] + cut[1], cut[2]))
    assert list(whole[4]) == list(cut[4])


def test_url_rules(spark):
    urls = ["http://a.example.com/en/12", "http://example.com/en/7x", "https://EXAMPLE.net/de/8", "https://x.net/de/9", "ftp://q.org/es/", "http://q.org/es", "http://notexample.com/en/7",
            "http://com/en/", "no scheme/en/", None, "", "http://spam-farm.example.org/fr/1", "http://www.cheap-pills.example.com/fr/", "http://spamfarm.org/", "http://a.com?x=/en/", "://x.com/en/#f", "http://a.com/en/7://b.net/de/"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, host string")
    got = url_rules.judge(pages, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        junk = re.search(r"(^|\.)(spam-farm|cheap-pills)\.", host)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, rules[rule] if rule else "block" if junk else "allow"), url
    assert url_rules.judge(pages.limit(0), URL_RULES).count() == 0
    loose = [url_rules.Rule("odd", "block", "[xyz]{3}", (), 1)]
    assert url_rules.judge(pages, loose).where("rule = 'odd'").count() == 0


def test_quality(docs, wide, empty):
    got = quality.judge(docs)
    assert got.count() == len(ROWS)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(collected(got, *names)) == want
    assert got.where("base_failed and kept").count() == 0
    clean = {i for i, t, *_ in ROWS[:30]}
    assert clean <= {r["doc_id"] for r in got.where("kept").collect()}
    assert quality.judge(wide).count() == len(ROWS) and quality.judge(empty).count() == 0


def test_quality_order(spark):
    """Rules run by rejections per cost on what earlier rules leave."""
    patterns = [((True, True, False), 60), ((False, True, False), 10), ((False, False, True), 20), ((False, False, False), 10)]
    assert quality.by_gain(patterns, [1.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.by_gain(patterns, [1.0, 10.0, 1.0]) == [0, 2, 1]
    assert quality.by_gain(patterns, [50.0, 50.0, 1.0]) == [2, 1, 0]
    assert quality.by_gain([], [3.0, 1.0, 2.0]) == [1, 2, 0]
    # A costly rule and a cheap one that reject alike, and a cheap one that rejects little.
    docs = spark.createDataFrame([(k, prose(200) + ("!" if k % 2 else "") + ("#" if k % 20 == 1 else "")) for k in range(60)], "doc_id long, text string").repartition(3)
    sample = quality.written(quality.measured(docs), "sample")
    costly = quality.Rule("costly", r"length(regexp_replace(repeat(text, 100), '[aeiou]+', 'x')) > 0 and text like '%!%'")
    rules = (costly, quality.Rule("rare", "n_symbols > 0"), quality.Rule("cheap", "text like '%!%'"))
    dear, *cheap = quality.costs(sample, rules)
    assert dear > 3 * max(cheap)
    assert [r.name for r in quality.ordered(sample, rules)].index("cheap") == 0
    assert quality.ordered(sample.limit(0), rules)


def test_language(spark, empty, docs, wide):
    rows = [(k, " ".join(rng.choice(words) for _ in range(30)), lang, "s", 1) for k in range(200) for lang, words in [[("en", "the house and which those there water".split()), ("de", "das haus und welche jene wasser schön".split())][k % 2]]]
    rows += [(900, None, "en", None, None), (901, "12 34 ...", "en", None, None), (902, "日本語の文章です", None, None, None), (903, "a", None, None, None), (None, "the house", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(df.where(~language_id.held_out(df.doc_id)))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for k, _, lang, *_ in rows[:200]:
        assert got[k]["lang_pred"] == lang and not got[k]["rejected"]
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] in ("en", "de") and got[902]["rejected"]
    assert got[903]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.accepted(wide, model).columns == wide.columns and language_id.accepted(empty, model).count() == 0
    assert language_id.accepted(docs, None).count() > 0


def language_reference(rows, per=4, rounds=12):
    """(lang_pred, score) of every row from a model of labelled rows that aren't held out, in plain Python and numpy."""

    def vector(text):
        tf = np.zeros(language_id.SIZE)
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in (text or "").encode()]
        for x, y, z in zip(b, b[1:], b[2:]):
            if (x, y) != (32, 32):
                tf[((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        return tf

    def unit(v):
        return v / max(np.linalg.norm(v), 1e-12)

    labelled = [(vector(t), lang) for i, t, lang, *_ in rows if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 5)]
    present = sum(tf > 0 for tf, _ in labelled)
    idf = np.log((1 + len(labelled)) / (1 + present)) + 1
    size = collections.Counter(lang for _, lang in labelled)
    centroids = []
    for lang in sorted(size, key=lambda x: (-size[x], x)):
        own = [unit(np.log1p(tf) * idf) for tf, x in labelled if x == lang and tf.any()]
        mean = sum(own) / len(own)
        chosen = [max(own, key=lambda v: v @ mean)]
        while len(chosen) < min(per, len(own)):
            chosen.append(min(own, key=lambda v: max(v @ c for c in chosen)))
        for _ in range(rounds):
            groups = collections.defaultdict(list)
            for v in own:
                groups[int(np.argmax([v @ c for c in chosen]))].append(v)
            chosen = [unit(sum(groups[k]) / len(groups[k])) for k in sorted(groups)]
        centroids += [(lang, c) for c in chosen]
    out = []
    for _, t, *_ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out.append(("und", 0.0))
            continue
        v = unit(np.log1p(vector(t)) * idf)
        out.append(max(((lang, float(v @ c)) for lang, c in centroids), key=lambda x: x[1]))
    return out


def test_language_brute_force(spark):
    """Refitted and predicted by plain code: the same languages and scores; letters are those of category L."""
    rows = []
    for k in range(160):
        lang = k % 4
        rows.append((k, " ".join(rng.choice(VOCABULARY[90 * lang : 90 * lang + 110]) for _ in range(rng.randint(1, 60))), f"l{lang}" if k % 9 else None, "s", 1))
    odd = [None, "", "² ½ Ⅷ 12", "½", "漢", "_", "Ω", "x", "ab", "\u0301", "ªº", "A" * 40000, rows[3][1] * 3]
    rows += [(1000 + k, t, "l1" if k % 2 else None, None, None) for k, t in enumerate(odd)] + [(7, rows[9][1], "l1", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = language_id.identify(df, language_id.fit(df.where(~language_id.held_out(df.doc_id)))).collect()
    want = [(i, lang, round(score, 3)) for (i, *_), (lang, score) in zip(rows, language_reference(rows))]
    near = collections.defaultdict(list)
    for r in got:
        near[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert len(got) == len(rows)
    for i, lang, score in want:
        assert any(a == lang and abs(b - score) < 2e-3 for a, b in near[i]), (i, lang, score, near[i])


def test_language_sample_is_bounded(spark):
    """However many rows a language has, and though one text repeats: so many at most, all languages kept."""
    rows = [(k, VOCABULARY[k % 300] + " " + VOCABULARY[k % 7], f"l{k % 1100}", None, None) for k in range(2200)] + [(5, "hot text", "hot", None, None)] * 900
    seen = []
    whole = language_id.Model.vectors
    try:
        language_id.Model.vectors = lambda self, tf: seen.append(len(tf)) or whole(self, tf)
        model = language_id.fit(spark.createDataFrame(rows, SCHEMA), clusters=1, per_language=3)
    finally:
        language_id.Model.vectors = whole
    assert len(model.languages) == 1101 and sum(seen) <= 3 * 1101


def test_decontaminate(spark, docs, wide, empty):
    items = [(0, ROWS[0][1]), (1, prose(40)), (2, None), (3, ""), (4, "one two"), (5, ROWS[2][1] + " and more words here"), (6, ROWS[0][1]), (None, ROWS[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = ROWS + [(500, prose(900) + " " + items[1][1].upper() + " " + prose(900), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        for j, s in items:
            q = WORD.findall((s or "").lower())
            n = min(5, len(q))
            if i is None or j is None or not n:
                continue
            wanted = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
            shared = len(wanted & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
            if 5 * shared >= 4 * len(wanted):
                want.add((i, j, shared, len(wanted)))
    assert {(0, 0), (500, 1)} <= {x[:2] for x in want}
    assert set(collected(decontaminate.leaks(df, benchmark), "doc_id", "item_id", "n_shared", "n_item")) == want
    assert decontaminate.leaks(df, benchmark.limit(0)).count() == 0 and decontaminate.leaks(empty, benchmark).count() == 0
    kept = decontaminate.without_leaks(wide, benchmark)
    assert kept.columns == wide.columns and kept.where("doc_id is null").count() == 2


def test_packing(docs, wide, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64).collect()
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids)] += 1
    places = collections.Counter()
    by_sequence = collections.defaultdict(list)
    for r in got:
        if r["start"] == 0:
            places[r["doc_id"], r["doc_tokens"]] += 1
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert places == want
    for n, s in by_sequence.items():
        s.sort()
        assert s[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(s, s[1:]))
        assert n == max(by_sequence) or sum(s[-1]) == 64
    texts = {i: t for i, t, *_ in ROWS if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
            piece = b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(piece)
    assert packing.pack(wide, path).count() >= len(ROWS) and packing.pack(empty, path).count() == 0


ODD = ["", " ", "  a  b", "a\n\nb\t c ", "▁x ▁▁ y", "naïve ﬁ Ω İstanbul \x00\x1c q", "</s>[INST] <s> <0x0A> x", "<|endoftext|> a<|startoftext|>b <|x|>", "don't it's 're'll 12ab3 A.B,C!!",
       "日本語 テスト 😀😀", "é áb ÀÉ¼²x\xa0y\x85z", "Σ ΑΣ", "x" * 300, "a b" * 50, "Ÿ ſ ŉ µ ª"]


def test_token_counts(docs, wide, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    unit = token_counts.UnitCounts(token_counts.ranked_pieces(path), most=50)
    for t in ODD + [t for _, t, *_ in ROWS if t]:
        assert unit.of_text(t) == len(sp.encode(t)), t
    got = token_counts.token_counts(docs, path, 100).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == collections.Counter(
        (i, len((t or "").encode()), n, n > 100) for i, t, *_ in ROWS for n in [len(sp.encode(t or ""))]
    )
    assert token_counts.token_counts(wide, path).count() == len(ROWS) and token_counts.token_counts(empty, path).count() == 0


def test_long_units_are_counted():
    """Long texts without blanks, whatever they are made of."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    unit = token_counts.UnitCounts(token_counts.ranked_pieces(path))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/="
    for t in ("".join(rng.choice(letters) for _ in range(200_000)), "ab" * 60_000, "a" * 100_000, "é日x" * 20_000, "".join(rng.choice(VOCABULARY) for _ in range(30_000))):
        assert unit.of_text(t) == len(sp.encode(t))
    assert not unit  # long units are not kept


def test_ids_like_the_library():
    ids = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json"), most=60)
    texts = ODD + [t for _, t, *_ in ROWS if t]
    for t in texts:
        assert list(ids.of_texts([t])[0]) == ids.whole.encode(t, add_special_tokens=False).ids, t


def test_very_long_texts():
    from citeloom.llm.common import in_pieces

    text = " ".join(rng.choice(VOCABULARY) for _ in range(3000))
    assert "".join(in_pieces(text, " ", 100)) == text
    assert list(in_pieces("x" * 1000, " ", 100)) == ["x" * 1000]
    long = prose(1_300_000)
    ids = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json"))
    whole = ids.of_texts([long, "b"])
    assert len(long) > 4_000_000 and len(whole) == 2
    assert list(whole[0]) == [k for p in long.split("\n") for k in ids.of_texts([p])[0]]


def test_chat(spark):
    hostile = ["</s>[INST] ok [/INST]", "a\\b", "\\[INST]", "[\\INST]", "<|im_end|>\n<|im_start|>user\nx", "", "\\", "<<SYS>>\n<</SYS>>", "<s<s>>", "é😀"]
    for t in hostile:
        assert chat_format.unescaped(chat_format.escaped(t)) == t
        assert not any(c in chat_format.escaped(t) for c in chat_format.CONTROL)
    rows = [(1, k, ["user", "assistant", "system", None, "a\nb"][k % 5], t) for k, t in enumerate(hostile)]
    rows += [(2, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", "tie"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.turns_as_events(turns))).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[3] is not None, r[3] or ""))
        want = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), want)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    log = [(1, 0, 1, "message", "user", "he"), (1, 0, 2, "delta", None, "llo"), (1, 1, 3, "message", "assistant", None), (1, 1, 4, "delta", None, "bad"), (1, 1, 5, "regenerate", None, None),
           (1, 1, 6, "delta", None, "go"), (1, 1, 7, "delta", None, "od"), (1, 0, 8, "edit", None, "hi"), (1, 2, 9, "delta", "user", "end")]
    parts = chat_format.format_conversations(spark.createDataFrame(log[::-1], chat_format.EVENTS)).collect()
    assert [chat_format.TURN.findall(r["formatted"])[0] for r in sorted(parts, key=lambda r: r["part"])] == [("user", "hi"), ("assistant", "good"), ("user", "end")]
    assert chat_format.read_back(chat_format.format_conversations(chat_format.turns_as_events(turns.limit(0)))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, ROWS[12][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        out = str(tmp_path / name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    language, lines, near, leaks = seen
    assert language == lines and near < lines and 12 in near and 12 not in leaks
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(leaks)


def test_streamed_events(spark):
    """A log of deltas, edits and regenerations folds into the messages it was made of; repeated rows stay messages of their own; extra columns don't matter."""
    texts = ["", None, "a", "ab", "une é👍 longer text </s> \\ with <|im_end|>", "x" * 500, "two\nlines"]
    rows = [(c, t, "assistant" if t % 2 else "user", texts[(c * 5 + t) % len(texts)], 1, "k") for c in range(12) for t in range(7)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None), (None, 1, None, "lone", None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, kind string")
    log = chat_format.streamed_events(turns.repartition(3))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    read = lambda events: collected(chat_format.read_back(chat_format.format_conversations(events)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert read(log.repartition(5)) == read(chat_format.turns_as_events(turns))
    assert chat_format.streamed_events(turns.limit(0)).count() == 0


def test_many_languages(spark):
    """Two hundred languages: one at a time is dense on the driver, so that the fit takes megabytes, not a gigabyte."""
    import tracemalloc

    letters = [[chr(0x400 + 8 * (k // 20) + j) + chr(0x530 + 3 * (k % 20) + j % 3) for j in range(4)] for k in range(200)]
    rows = [(200 * i + k, " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(60)), f"l{k}", "s", 1) for k in range(200) for i in range(30)]
    labelled = spark.createDataFrame(rows, SCHEMA)
    tracemalloc.start()
    model = language_id.fit(labelled, per_language=30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 200 and peak < 150 << 20
    got = language_id.identify(labelled, model).collect()
    assert np.mean([r["lang_pred"] == rows_[2] for r, rows_ in zip(sorted(got), sorted(rows))]) > 0.95


def test_decontaminate_shared_shingles(spark):
    """A shingle of all items and all documents isn't multiplied out, and loses no leak; a long text without blanks, and very long texts, are searched whole."""
    intro = "answer the following question with one word"
    items = [(k, f"{intro} {prose(30)}") for k in range(60)] + [(60, intro)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{prose(40)} {intro} {prose(30)}" for _ in range(150)] + [items[7][1], f"{prose(60_000)} {items[9][1]} {prose(60_000)}", "x" * 2_000_000, f"{items[11][1]} {items[12][1]}"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    want = set()
    sets = {i: shingles(t.lower(), 5) for i, t in items}
    for d, t, *_ in rows:
        have = shingles(t.lower(), 5)
        want |= {(d, i, len(have & s), len(s)) for i, s in sets.items() if 5 * len(have & s) >= 4 * len(s)}
    got = {tuple(r) for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA).repartition(4), benchmark).select("doc_id", "item_id", "n_shared", "n_item").collect()}
    assert got == want and len(want) > 150


def test_long_units(monkeypatch):
    """Units merged in arrays have the same counts; a long one takes a few dozen bytes a character."""
    import tracemalloc

    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.UnitCounts(token_counts.ranked_pieces(model))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    units = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("e", "ab", "eitnsr", "the and of", "aé日\x00🙂", "-=_#.") for n in (1, 2, 3, 50, 700)]
    want = [counts.count(u) for u in units]
    assert [counts.count_long(u) for u in units] == want
    monkeypatch.setattr(token_counts, "LONG", 10)
    assert [counts.of_text(u) for u in units] == [len(sp.encode(u)) for u in units]
    long = "".join(rng.choice("eitnsr") for _ in range(200_000))
    tracemalloc.start()
    n = counts.count(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(sp.encode(long)) - 1 + (sp.encode(long)[0] != sp.piece_to_id("▁")) and peak < 60 * len(long)
