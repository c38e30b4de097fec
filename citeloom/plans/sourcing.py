"""Queries of sources and sinks, and of helpers of one value: what is written is read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scalars
from ..sources import csv_shards, fixtures, xml_sections
from ..streaming import audit
from ..tables import Ledger, shared_dir
from .registry import query
from .views import Corpus


def _path(c: Corpus, name: str) -> str:
    return f"{shared_dir(c.spark)}/citeloom-{name}-{uuid.uuid4().hex}"


def _pick(key: str, *values: str | None) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name || chr(10) || '\"a\", \\ b' AS text, NULL AS reject FROM nation UNION ALL SELECT NULL, NULL, 'width 4 instead of 3'")
def s3_sharded_csv(c: Corpus) -> DataFrame:
    """Records of several lines in the dialect of COPY, cut into small ranges; one record is too wide."""
    body = F.concat("n_name", F.lit('\n"a", \\ b'))
    escaped = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rows = c.table("nation").select(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('","2020-01-01","'), escaped, F.lit('"')).alias("value"))
    wide = c.spark.createDataFrame([('"99","2020-01-01","x","y"',)], "value string")
    path = _path(c, "copy")
    rows.union(wide).coalesce(1).write.text(path)  # the table has 25 rows
    found = c.spark.read.format("binaryFile").load(path).where("length > 0").select("path").first()["path"]
    c.spark.dataSource.register(csv_shards.ShardedCsv)
    read = c.spark.read.format("sharded_csv").options(columns="id,date,text", shardBytes=200).load(found)
    return read.select("id", "text", F.col("_reject").alias("reject"))


def _copied(text: Column) -> Column:
    """A text in quotes as the dialect of COPY writes it."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


@query("SELECT doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS digest, coalesce(lang, '') AS lang FROM documents WHERE len(coalesce(text, '')) <= 50000 UNION ALL SELECT NULL, NULL, NULL FROM documents WHERE len(text) > 50000")
def s2_bz2_blocks(c: Corpus) -> DataFrame:
    """All documents as bz2 files in the dialect of COPY, read back by ranges of compressed bytes, columns by their names; monstrous texts are quarantined."""
    path = _path(c, "bz2")
    parts = F.concat_ws(",", F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"')), F.lit('"2020-01-01"'), _copied(F.coalesce("lang", F.lit(""))), _copied(F.coalesce("text", F.lit(""))))
    with_header = F.when(F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("doc_id")) == 1, F.concat(F.lit('id,date,lang,text\n'), parts)).otherwise(parts)
    c.table("documents").select(with_header.alias("value")).write.text(path, compression="bzip2")
    c.spark.dataSource.register(csv_shards.ShardedCsv)
    read = c.spark.read.format("sharded_csv").options(columns="id,text,lang", header=True, shardBytes=100_000, maxFieldChars=50_000).load(path)
    return read.select("id", F.sha2("text", 256).alias("digest"), "lang")


@query("SELECT 'width 4 instead of 3' AS reason, 1 AS n")
def s5_rejects(c: Corpus) -> DataFrame:
    """Rejected records by reason."""
    read = s3_sharded_csv(c).withColumnRenamed("reject", "_reject")
    return xml_sections.rejects(read).select(F.col("_reject").alias("reason"), "n")


@query(
    """, r AS (SELECT o_orderkey AS id, ['0.5', 'x', ' 2 ', '', NULL, '1e2', '7'][(o_orderkey % 7)::INT + 1] AS s, ['a', ' ', 'b'][(o_orderkey % 3)::INT + 1] AS t FROM orders)
    SELECT id, try_cast(trim(s) AS DOUBLE) AS score FROM r WHERE try_cast(trim(s) AS DOUBLE) IS NOT NULL AND trim(t) <> ''"""
)
def s8_scored_rows(c: Corpus) -> DataFrame:
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), _pick("o_orderkey", "0.5", "x", " 2 ", "", None, "1e2", "7").alias("s"), _pick("o_orderkey", "a", " ", "b").alias("t"))
    return fixtures.scored(rows, F.col("s"), F.col("t")).select("id", "score")


@query(
    """, n AS (SELECT 'opinions' AS name, count(*) AS n FROM opinions WHERE NOT blocked UNION ALL SELECT 'anchors', count(*) FROM anchors)
    SELECT attempt, name, n, attempt = 'again' AS reused FROM n, (VALUES ('first'), ('again')) t(attempt)"""
)
def s21_stages(c: Corpus) -> DataFrame:
    """Opinions and anchors as a stage that commits them together; asked for again, it is read and nothing is made."""
    ledger, made = Ledger(c.spark, _path(c, "ledger")), []

    def make() -> dict[str, DataFrame]:
        made.append(1)
        return {"opinions": c.opinions.where("not blocked").drop("text"), "anchors": c.anchors}

    found = []
    for attempt in ("first", "again"):
        before = len(made)
        tables = ledger.stage("corpus", [c.sf_dir], {"version": 1}, make)
        counts = [t.agg(F.count("*").alias("n")).select(F.lit(attempt).alias("attempt"), F.lit(name).alias("name"), "n", F.lit(len(made) == before).alias("reused")) for name, t in tables.items()]
        found += counts
    return reduce(DataFrame.unionByName, found)


@query(
    """, g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS run FROM g),
    s AS (SELECT user_id, min(ts) AS begun, max(ts) AS last, count(*) AS n, arg_max(event_type, (ts, event_type)) AS last_type, lead(run) OVER (PARTITION BY user_id ORDER BY run) IS NOT NULL AS followed FROM r GROUP BY user_id, run)
    SELECT user_id, epoch_us(begun) AS begun, epoch_us(last) AS last, n, last_type FROM s WHERE followed OR last + INTERVAL 3 HOUR < (SELECT max(ts) FROM events)"""
)
def s24_stale_runs(c: Corpus) -> DataFrame:
    """The events as an append-only log, read as a stream, whose runs the next event or a timer ends."""
    events, found, state = _path(c, "log"), _path(c, "runs"), _path(c, "state")
    c.table("events").write.parquet(events)
    audit.append(audit.stale_runs(audit.read_log(c.spark, events)), found, state).awaitTermination()
    runs = c.spark.read.schema(audit.RUN).parquet(found)
    return runs.select("user_id", F.unix_micros("begun").alias("begun"), F.unix_micros("last").alias("last"), "n", "last_type")


def _feed(c: Corpus, kind: str, section: Column, head: str, foot: str) -> str:
    """The parts' sections as ten XML files; the last one's document isn't closed."""
    path, part = _path(c, kind), c.table("part")
    rows = part.select((F.col("p_partkey") % 10).alias("file"), (F.col("p_partkey") + 1).alias("k"), section.alias("value"))
    files = part.select((F.col("p_partkey") % 10).alias("file")).distinct()
    last = part.agg(F.max("p_partkey") + 2).first()[0]
    rows = rows.unionByName(files.select("file", F.lit(-1).cast("long").alias("k"), F.lit(head).alias("value")))
    rows = rows.unionByName(files.where("file < 9").select("file", F.lit(last).cast("long").alias("k"), F.lit(foot).alias("value")))
    rows.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


_SECTIONS = "SELECT p_partkey::VARCHAR AS section, p_name AS heading, {} AS text, NULL AS error FROM part WHERE p_partkey % 10 < 9 UNION ALL SELECT NULL, NULL, NULL, 'ParseError' FROM (SELECT 1 FROM part WHERE p_partkey % 10 = 9 LIMIT 1)"


@query(_SECTIONS.format("'(a) ' || p_type || ' rest ' || p_brand"))
def s9_regulation_sections(c: Corpus) -> DataFrame:
    """Sections of a regulation feed, mixed content in order; a file that isn't XML is a row with its error."""
    section = F.format_string('<DIV8 TYPE="SECTION" N="%s"><HEAD>%s</HEAD><P>(a) <I>%s</I> rest</P><HD1>%s</HD1><X>no body</X></DIV8>', F.col("p_partkey").cast("string"), "p_name", "p_type", "p_brand")
    read = xml_sections.sections(c.spark, _feed(c, "regulation", section, "<R>", "</R>"), "regulation")
    return read.select("section", "heading", "text", F.regexp_extract("error", r"^(\w+)", 1).alias("error"))


@query(_SECTIONS.format("p_type || ' ' || p_brand"))
def s10_code_sections(c: Corpus) -> DataFrame:
    """Sections of a code feed, whatever their namespace; their bodies are those of the highest elements."""
    section = F.format_string('<section identifier="sec_%s"><heading>%s</heading><level><content>%s</content></level><note><P>%s</P></note></section>', F.col("p_partkey").cast("string"), "p_name", "p_type", "p_brand")
    read = xml_sections.sections(c.spark, _feed(c, "code", section, '<d xmlns="urn:x">', "</d>"), "code")
    return read.select("section", "heading", "text", F.regexp_extract("error", r"^(\w+)", 1).alias("error"))


@query("SELECT doc_id::VARCHAR AS text, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS answer FROM labels")
def s14_dictionary(c: Corpus) -> DataFrame:
    path = _path(c, "tsv")
    c.table("labels").select(F.col("doc_id").cast("string").alias("text"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("answer")).write.csv(path, sep="\t", header=True)
    return fixtures.dictionary(c.spark, path)


@query("SELECT 'case-' || n_nationkey AS id, n_name AS q, [n_nationkey::BIGINT, n_regionkey::BIGINT][2] AS expected FROM nation")
def s15_cases(c: Corpus) -> DataFrame:
    """Cases written as arrays of JSON, with members of their own exploded."""
    path = _path(c, "cases")
    case = F.struct(F.concat(F.lit("case-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("q"), F.array(F.struct(F.col("n_regionkey").cast("long").alias("id"))).alias("expect"))
    c.table("nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(case), {"pretty": "true"}).alias("value")).select("value").repartition(5).write.option("lineSep", "\n").text(path)
    read = fixtures.cases(c.spark, path, "id string, q string, expect array<struct<id: long>>")
    return read.select("id", "q", F.explode("expect").alias("e")).select("id", "q", F.col("e.id").alias("expected"))


@query("SELECT id, cluster_id FROM opinions WHERE id % 3 = 1")
def s16_many_keys(c: Corpus) -> DataFrame:
    """Rows of many keys, some of which don't exist."""
    ids = c.table("documents").where("doc_id % 3 = 1").select(F.col("doc_id").alias("id"))
    return fixtures.looked_up(c.opinions, ids.union(ids.select(-F.col("id") - 1))).select("id", "cluster_id")


@query("SELECT count(*) AS opinions, count_if(blocked) AS blocked, sum(len(text))::BIGINT AS chars FROM opinions")
def s23_report(c: Corpus) -> DataFrame:
    """A summary written as JSON and read back."""
    path = _path(c, "report")
    summary = c.opinions.agg(F.count("*").alias("opinions"), F.count_if("blocked").alias("blocked"), F.sum(F.length("text")).alias("chars"))
    fixtures.report(summary, path)
    return c.spark.read.schema("opinions long, blocked long, chars long").json(path)


@query(
    """, r AS (SELECT o_orderkey AS id, ['', ' ', NULL, 'plain'][(o_orderkey % 4)::INT + 1] AS a, ['html', NULL, ' '][(o_orderkey % 3)::INT + 1] AS b, ['xml', ''][(o_orderkey % 2)::INT + 1] AS c FROM orders)
    SELECT id, CASE WHEN trim(coalesce(a, '')) <> '' THEN 'a' WHEN trim(coalesce(b, '')) <> '' THEN 'b' WHEN trim(coalesce(c, '')) <> '' THEN 'c' END AS of,
    CASE WHEN trim(coalesce(a, '')) <> '' THEN a WHEN trim(coalesce(b, '')) <> '' THEN b WHEN trim(coalesce(c, '')) <> '' THEN c ELSE '' END AS value FROM r"""
)
def p4_first_non_blank(c: Corpus) -> DataFrame:
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), _pick("o_orderkey", "", " ", None, "plain").alias("a"), _pick("o_orderkey", "html", None, " ").alias("b"), _pick("o_orderkey", "xml", "").alias("c"))
    best = scalars.first_non_blank(["a", "b", "c"])
    return rows.withColumn("x", best).select("id", F.col("x.source").alias("of"), F.coalesce("x.value", F.lit("")).alias("value"))


@query("SELECT id, date_filed + (id % 100 - 50)::INT AS moved, (DATE '2010-06-15' - date_filed)::INT AS days FROM opinions")
def d2_days(c: Corpus) -> DataFrame:
    """Days added, and signed days between dates."""
    return c.opinions.select("id", F.date_add("date_filed", (F.col("id") % 100 - 50).cast("int")).alias("moved"), F.datediff(F.lit("2010-06-15").cast("date"), "date_filed").alias("days"))


@query(
    """, r AS (SELECT o_orderkey AS id, ['Holding that the duty exists', 'See 410 U.S. 113 and Id.', '  two   blanks ', 'Ringing'][(o_orderkey % 4)::INT + 1] AS q FROM orders)
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(q), '(?i)^[a-z]+ing\\s+(?:that\\s+)?', ''), '\\b\\d{1,4}\\s+[A-Z][A-Za-z.'']*\\.[A-Za-z0-9.'' ]*?\\s*\\d{1,6}\\b|\\bId\\.', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM r"""
)
def x22_cleaned_queries(c: Corpus) -> DataFrame:
    q = _pick("o_orderkey", "Holding that the duty exists", "See 410 U.S. 113 and Id.", "  two   blanks ", "Ringing")
    return c.table("orders").select(F.col("o_orderkey").alias("id"), scalars.cleaned_query(q).alias("bare"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'RECORD' WHEN 'user' THEN 'LAW' END AS tag, role NOT IN ('system', 'user') AS rejected FROM conversations")
def x29_tag_gate(c: Corpus) -> DataFrame:
    """Sentences with a tag that isn't known are rejects."""
    tag = F.when(F.col("role") == "system", "RECORD").when(F.col("role") == "user", "LAW").otherwise("RUMOUR")
    rows = c.table("conversations").select("conv_id", "turn", scalars.known_tag(tag).alias("tag"))
    return rows.withColumn("rejected", F.col("tag").isNull())
