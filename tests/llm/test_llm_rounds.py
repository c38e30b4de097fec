"""Cases of the reviews, each of which failed before its finding was settled."""

import random

import corpus_pipeline
from citeloom.llm import language_id, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(2000)]


def line(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_pipeline_copies(spark, tmp_path):
    """Of four exact copies, and of copies that white space sets apart, one document reaches the end."""
    texts = ["\n".join(line(25) for _ in range(4)) for _ in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[3], "en", "s", len(texts[3])) for k in range(3)]
    rows += [(200 + k, texts[5].replace("\n", "\n\n \n"), "en", "s", len(texts[5]) + 9) for k in range(2)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, line(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == set(range(40))


def test_line_of_two_documents(spark):
    """A long line that exactly two documents share goes from the second, as do variants of one template."""
    shared, variant = line(60), line(10)
    rows = [(1, f"{line(20)}\n{shared}"), (2, f"{shared}\n{line(20)}"), (3, f"at 10:01 {variant}\n{line(20)}"), (4, f"{line(20)}\nat 11:59 {variant} "), (5, line(20))]
    rows += [(6, f"{line(9)} {k}") for k in range(2)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_recurring(docs).collect())
    want = [(k, t.split("\n")[{2: 1, 4: 0}[k]] if k in (2, 4) else t) for k, t in rows]
    assert got == sorted(want)


def test_language_long_foreign(spark):
    """Texts of no learned language are rejected however long they are, and clean documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    model = language_id.fit(docs.where(~language_id.held_out(docs.doc_id)))
    polish = "się nie jest który przez wszystko człowiek źródło często jeszcze dzień książka współpraca także można szczęście".split()
    letters = lambda low, high: "".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 9)))
    foreign = [w for n in (20, 200, 2000, 20000) for w in (
        " ".join(letters(97, 122) for _ in range(n)), " ".join(letters(0x4E00, 0x9FA5) for _ in range(n)), " ".join(rng.choice(polish) for _ in range(n)))]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(foreign)], SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(rows, model).collect()}
    assert [k for k in got if not got[k]["rejected"]] == []
    words = docs.where("text rlike '[A-Za-z]{2}'")
    judged = language_id.identify(words, model).where("rejected").select("doc_id").collect()
    assert [r["doc_id"] for r in judged] == []
