"""Alignment, resampling and best-fit packing against brute force with the tokenizers' own libraries."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from citeloom.llm import align, best_fit, byte_bpe, queries, resample

FOLDER = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
ODD = [
    "", " ", "  ", "\n\n", "one", "one two", "one two", "it's  we'll\tthey've", "ÀÉ Ü", "123 456 7", "aaaa" * 40, "a " * 300, "日本語 テスト " * 20, "\x00\x01 b", "é́x",
    "</s> [INST] <|endoftext|> \\ x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "x▁y ▁", "▁", "emoji 🙂🙃 ‍ end", "tail \n", "trailing   ", " nbsp em  　 wide",
    " ".join(rng.choice(["deed", "grant", "Über", "x1", "§", "ok."]) for _ in range(5000)),
]


def rows():
    out = [(k, t, "en", "s", 1) for k, t in enumerate(ODD)]
    out += [(len(out), None, None, None, None), (None, "one two three " * 9, "en", "s", 1), (None, None, None, None, None), (4, "one", "en", "s", 1), (5, "again " * 30, "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    from pyspark.sql import functions as F

    names = "part block at n ids piece start length rank base pair place places count best b found score weight able sequence first per offset rows stream doc_ids n_words bucket".split()
    return docs.withColumns({n: F.lit("clash") for n in names})


def texts_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def library(special):
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = not special
    return lambda t: whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_byte_bpe(spark, special):
    """Every entry of the vocabulary alone, and whole texts, as the library encodes them."""
    own, want = byte_bpe.ByteBpe(JSON, special), library(special)
    entries = [b.decode() for b in own.bytes_of if not b.decode(errors="replace").count("�")]
    for t in [*entries, *(t for t in ODD), *(t or "" for _, t in texts_of(spark))]:
        assert own.ids(t).tolist() == want(t)


def test_between_words(monkeypatch):
    text = "one  two \n three four  five six seven  " * 3
    parts = list(byte_bpe.between_words(text, 7))
    assert "".join(parts) == text and len(parts) > 5
    own, want = byte_bpe.ByteBpe(JSON, False), library(False)
    assert np.concatenate([own.ids(p) for p in parts]).tolist() == want(text)


# ------------------------------------------------------------------- alignment


def brute_alignment(pairs):
    """The contract's rows by sets of end offsets, with the libraries' own encoders."""
    encode, sp = library(False), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte_of = byte_bpe.byte_characters()
    token = {k: t for t, k in Tokenizer.from_file(JSON).get_vocab().items()}

    def piece_bytes(k):
        return bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()

    found, count = [], collections.Counter()
    for doc, text in pairs:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = encode(" " + text), sp.encode(text)
            bytes_a, bytes_b = [bytes(byte_of[c] for c in token[k]) for k in a], [piece_bytes(k) for k in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = (dict(zip(np.cumsum([len(x) for x in y]).tolist(), range(len(y)))) for y in (bytes_a, bytes_b))
                i = j = 0
                for e in sorted(ends_a.keys() & ends_b.keys()):
                    groups.append(",".join(map(str, a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, b[j : ends_b[e] + 1])))
                    links.append((a[ends_a[e]], b[ends_b[e]]))
                    i, j = ends_a[e] + 1, ends_b[e] + 1
        count.update(links)
        found.append((doc, len(a), len(b), groups, links))
    highest = collections.Counter()
    for (x, y), n in count.items():
        highest[y] = max(highest[y], n)
    return collections.Counter(
        (doc, n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in found
    )


def test_alignment_counts(spark, docs, wide, monkeypatch):
    want = brute_alignment([r[:2] for r in rows()])
    assert collections.Counter(tuple(r) for r in align.alignment_counts(docs, JSON, MODEL).collect()) == want
    assert collections.Counter(tuple(r) for r in align.alignment_counts(wide, JSON, MODEL).collect()) == want
    assert align.alignment_counts(docs.limit(0), JSON, MODEL).count() == 0
    assert align.alignment_counts(docs.where("text = ''"), JSON, MODEL).select("n_links", "groups_sha256").collect() == [(0, "")]


def test_alignment_rows_are_small(spark, monkeypatch):
    """a block's rows are its documents and some pairs each, and no list of a block's pairs is gathered; results are the same over several blocks."""
    aligner = align._aligner(JSON, MODEL)
    monkeypatch.setattr(align, "BLOCK_LINKS", 300)
    monkeypatch.setattr(align, "ROW_PAIRS", 7)
    monkeypatch.setattr(align, "BATCH_BYTES", 40)
    block, texts = align._Block(), [t for _, t in texts_of(spark) if t][:40] + ["", "x▁y"]
    for k, found in enumerate(align._described(aligner, texts)):
        block.add(k, *found)
    made = [r for batch in block.rows(5) for r in batch.to_pylist()]
    docs, pairs = [r for r in made if r["first"] is None], [r for r in made if r["first"] is not None]
    assert [r["doc_id"] for r in docs] == list(range(42)) and max(len(r["pairs"]) for r in pairs) == 7 and {r["block"] for r in made} == {5}
    assert all(len(r["places"]) == 4 * r["n_groups"] for r in docs)
    flat, ns = [p for r in pairs for p in r["pairs"]], [n for r in pairs for n in r["ns"]]
    said = [flat[k] for r in docs for k in np.frombuffer(r["places"], "<u4")]
    assert collections.Counter(said) == dict(zip(flat, ns, strict=True)) and flat == sorted(flat)
    assert "collect_list" not in align.alignment_counts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), JSON, MODEL)._jdf.queryExecution().toString()


def test_alignment_in_pieces(monkeypatch):
    """Pieces, steps and documents of one block have the digests of whole texts."""
    aligner = align.Aligner(JSON, MODEL)
    texts = [t for t in ODD]
    whole = align._described(aligner, texts)
    monkeypatch.setattr(align, "between_words", lambda t: byte_bpe.between_words(t, 50))
    monkeypatch.setattr(align, "STEP_CHARS", 100)
    parts = align._described(aligner, texts)
    assert [x[:3] for x in whole] == [x[:3] for x in parts]
    assert all(np.concatenate(x[3]).tolist() == np.concatenate(y[3]).tolist() for x, y in zip(whole, parts) if x[3])


def test_alignments(docs):
    """Overlaps are all pairs of tokens that share bytes; cuts all offsets where both end."""
    aligner = align._aligner(JSON, MODEL)
    for r in align.alignments(docs, JSON, MODEL).collect():
        ends = [np.cumsum([len(table[k]) for k in ids]).tolist() for table, ids in ((aligner.a.bytes_of, r["a_ids"]), (aligner.b.bytes_of, r["b_ids"]))]
        starts = [[0, *e[:-1]] for e in ends]
        assert r["cuts"] == sorted(set(ends[0]) & set(ends[1]))
        if len(ends[0]) < 200:
            want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
            assert [tuple(x) for x in r["overlaps"]] == want


def test_alignment_on_a_table(spark):
    assert collections.Counter(tuple(r) for r in queries.op11_align(spark, FOLDER).collect()) == brute_alignment(texts_of(spark))


# ------------------------------------------------------------------ resampling


def brute_resample(pairs, target, percent=5, least=20):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        return [zlib.crc32(f.encode()) % 10000 for f in runs], len(words)

    own = [(d, *features(t)) for d, t in pairs]
    s, t = collections.Counter(b for _, f, _ in own for b in f), collections.Counter(b for x in target for b in features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for d, f, n in own:
        weight, score = sum(gain[b] for b in f), None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
        if n >= least and d is not None:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return collections.Counter(map(tuple, out))


def test_resample(spark, docs, wide):
    words = ["deed", "grant", "Lease", "écrit", "x1", "title", "-", "§§"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate([*texts[:9], None, "", "deed of grant"])], "item_id long, text string")
    many = docs.unionByName(spark.createDataFrame([(100 + k, t, "en", "s", 1) for k, t in enumerate([*texts, texts[0], texts[0]])] + [(100, texts[0], "en", "s", 1)], SCHEMA))
    pairs = [(r["doc_id"], r["text"]) for r in many.collect()]
    target = [r["text"] for r in aim.collect()]
    for percent in (5, 50, 100):
        assert collections.Counter(tuple(r) for r in resample.resample(many, aim, percent).collect()) == brute_resample(pairs, target, percent)
    assert collections.Counter(tuple(r) for r in resample.resample(wide, aim).collect()) == brute_resample([r[:2] for r in rows()], target)
    assert collections.Counter(tuple(r) for r in resample.resample(docs, aim.limit(0)).collect()) == brute_resample([r[:2] for r in rows()], [])
    assert resample.resample(docs.limit(0), aim).count() == 0


def test_buckets_in_parts(monkeypatch):
    text = " ".join(rng.choice(["a", "Bc", "d-e", "ü"]) for _ in range(500))
    whole, n = resample.buckets_of(text, 10000)
    monkeypatch.setattr(resample, "PART_BYTES", 7)
    parts, m = resample.buckets_of(text, 10000)
    assert n == m and sorted(whole.tolist()) == sorted(parts.tolist())


def test_run_lengths():
    values, n = resample.run_lengths(np.array([3, 1, 3, 3, 0], np.uint16))
    assert values.tolist() == [0, 1, 3] and n.tolist() == [1, 1, 3]
    assert len(resample.run_lengths(np.zeros(0, np.uint16))[0]) == 0


# ------------------------------------------------------------ best-fit packing


def plain_best_fit(lengths, capacity):
    """Sequences that best fit in descending order takes."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


LENGTHS = {
    "thirds": [rng.randint(335, 350) for _ in range(900)],
    "halves": [rng.randint(500, 540) for _ in range(401)],
    "uniform": [rng.randint(1, 1024) for _ in range(800)],
    "large and small": [rng.randint(600, 900) for _ in range(300)] + [rng.randint(10, 424) for _ in range(300)],
    "same": [341] * 100,
    "one": [5],
    "full": [1024] * 7,
    "none": [],
}


@pytest.mark.parametrize("name", LENGTHS)
@pytest.mark.parametrize("share,groups", [*best_fit.SETTINGS, (4, 5)])
def test_plans(name, share, groups):
    """Every rank of every length in one place, sequences gapless and not over their size."""
    counts = np.bincount(np.array(LENGTHS[name], int), minlength=1025)
    plan = best_fit.Plan(counts, 1024, share, groups)
    filled, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for r in plan.runs:
        ranks[r.length] += range(r.first, r.first + r.n)
        for i in range(r.n):
            filled[r.sequence + i // r.per].append((r.offset + i % r.per * r.length, r.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in enumerate(counts.tolist()) if n}
    assert len(filled) == plan.sequences
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024


@pytest.mark.parametrize("name", LENGTHS)
def test_planned(name):
    """No more sequences than plain best fit; fewer where large lengths only go together by threes."""
    lengths = LENGTHS[name]
    got, plain = best_fit.planned(np.bincount(np.array(lengths, int), minlength=1025), 1024).sequences, plain_best_fit(lengths, 1024)
    assert -(-sum(lengths) // 1024) <= got <= plain
    if name == "thirds":
        assert got < 0.93 * plain


def checked_pieces(got, pairs, size=1024):
    """Pieces against the library's ids; the number of sequences."""
    encode = library(True)
    want, own = [], [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
    for doc, text in pairs:
        ids = encode(text or "") + [2]
        edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert collections.Counter(own) == collections.Counter(want)
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= size
    return len(filled)


def test_best_fit(docs, wide, monkeypatch):
    pairs = [r[:2] for r in rows()]
    got = best_fit.pack(docs, JSON).collect()
    checked_pieces(got, pairs)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    monkeypatch.setattr(best_fit, "BROADCAST_ROWS", 0)
    checked_pieces(best_fit.pack(wide, JSON, with_ids=False).collect(), pairs)
    assert best_fit.pack(docs.limit(0), JSON).count() == 0


def test_best_fit_on_a_table(spark):
    got = queries.op13_best_fit(spark, FOLDER).collect()
    n = checked_pieces(got, texts_of(spark))
    assert n <= plain_best_fit([r["length"] for r in got], 1024)


def test_streams_are_rows_of_documents(spark, monkeypatch):
    """no row of op12's table is larger than its document; weights and counts are the same whatever is taken at once."""
    from pyspark.sql import functions as F

    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three four").alias("text")).coalesce(1)
    assert resample.streams(many).agg(F.count("*"), F.max(F.length("stream"))).first()[:] == (2000, 18)
    sizes = [0, 3, 0, 11, 1, 0, 26, 0]
    got = [np.array([rng.randrange(9) for _ in range(n)], "<u2") for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([0] * 9), pa.array([b"xy", *[g.tobytes() for g in got]], pa.binary())], ["doc_id", "n_words", "stream"]).slice(1)
    gain = np.array([rng.randrange(-50, 50) for _ in range(9)])
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(resample, "STREAM", size)
        found = next(resample._weighed(gain)(iter([batch]))).to_pydict()
        assert found["n_features"] == sizes and found["weight"] == [int(gain[g].sum()) for g in got]
        counted = next(resample._counted(iter([batch.select(["stream"])]))).to_pydict()
        assert dict(zip(counted["bucket"], counted["n"], strict=True)) == collections.Counter(np.concatenate(got).tolist())
