"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, best_fit, chat_format, decontaminate, language_id, line_dedup, ngram_join, packing, quality, resample, suffix_dedup, token_counts, url_rules
from .common import table

#: Rules that the contract of op3 fixes, and the operator's own for hosts of junk.
URL_RULES = [
    url_rules.host_rule("block", "com/en/"),
    url_rules.host_rule("allow", "example.com/en/7"),
    url_rules.host_rule("allow", "net/de/"),
    url_rules.host_rule("block", "example.net/de/8"),
    url_rules.host_rule("block", "org/es/"),
    url_rules.words_rule("block", "spam", ("spam", "farm")),
    url_rules.words_rule("block", "pills", ("cheap", "pills")),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and what is left of every document."""
    found = line_dedup.drop_recurring(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, (9, 10))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out(F.col("doc_id")))))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they hold."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are made of another template's control strings, as logs of deltas, edits and regenerations."""
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(chat_format.streamed_events(turns)))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.alignment_counts(table(spark, sf_dir, "documents"), *tokenizers)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_ngram_join, op3_url_filter, op4_quality_rules, op5_language_id,
        op6_decontaminate, op7_packing, op8_suffix_dedup, op9_token_counts, op10_chat_format, op11_align, op12_resample, op13_best_fit,
    )
}

_BLANKS = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_BLANKS}'), lambda w: w <> '')"
_CONTROL = r"\\|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, line, list_transform({_WORDS.format("line")}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws FROM l),
n AS (SELECT doc_id, i, ws, len(ws) AS n, len(ws) // 5 AS k FROM t WHERE len(ws) > 0),
s AS (SELECT doc_id, i, unnest(CASE WHEN k = 0 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(0, (n - 4 + k) // k), lambda j:
      array_to_string(ws[:3 + j * k] || list_transform(range(0, least(k, n - 3 - j * k)), lambda x: '<*>') || ws[4 + (j + 1) * k:], ' ')) END) AS g FROM n),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
x AS (SELECT DISTINCT doc_id, i FROM s JOIN f USING (g) WHERE first < doc_id),
k AS (SELECT t.doc_id, count(*) FILTER (len(ws) > 0) AS n_lines, count(x.i) AS n_dropped, string_agg(line, chr(10) ORDER BY t.i) FILTER (x.i IS NULL) AS kept
      FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.i = t.i GROUP BY t.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, ''))::BIGINT AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
""",
    "op2_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM s),
g AS (SELECT doc_id, unnest(gs) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT id, min(reached) AS c FROM r GROUP BY id) m ON m.id = n.doc_id
""",
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM a)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
      WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op4_quality_rules": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
d AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM h, range(0, 5) t(k) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(d.n, 0) AS n_repeat_words,
      len(list_filter(ws, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS no_letter, len(regexp_extract_all(text, '!')) AS bangs FROM w LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
      n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
      OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * no_letter > n_words OR 2 * bangs > n_words) AS kept FROM b
""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS ws FROM benchmark),
i AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM b),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM d WHERE len(ws) >= 5),
c AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, c AS n_shared, n AS n_item FROM c JOIN n USING (item_id) WHERE 5 * c >= 4 * n
""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 298) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 100)) AS j FROM d)),
w AS (SELECT doc_id, j + i AS i, hash(substr(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, j, x, unnest(range(0, least(100, len(x) // 2 - 49))) AS i FROM c)),
m AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g),
r AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN m USING (g) WHERE m.f < w.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, n),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM s),
p AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head, max(b) AS last FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)
""",
    "op10_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(24 + len(role) + len(text) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op12_resample": f"""
WITH RECURSIVE c AS (SELECT i AS k, i AS v, 0 AS j FROM range(256) t(i) UNION ALL
     SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, j + 1 FROM c WHERE j < 8),
z AS (SELECT list(v ORDER BY k) AS crc FROM c WHERE j = 8),
w AS (SELECT 0 AS side, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, NULL, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
      list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
g AS (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda r, x: xor(r >> 8, crc[xor(r & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM u, z),
n AS (SELECT i AS b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM range(10000) r(i) LEFT JOIN b ON b.b = i LEFT JOIN g USING (f) GROUP BY i),
k AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN b USING (f) JOIN k USING (b) WHERE side = 0 GROUP BY doc_id),
d AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
      floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (doc_id) WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM d WHERE n_words >= 20)
SELECT d.doc_id, d.n_features, d.weight, d.score, CASE WHEN r.r <= 5 * r.n // 100 THEN r.r END AS rank FROM d LEFT JOIN r USING (doc_id)
""",
}
