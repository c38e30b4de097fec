"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule's cost (seconds a row) and selectivity (share of the rows left that it
rejects) are estimated on a sample from all partitions; rules then run in order of
rejection per cost, and a row that one rejects is spared the rest. The order
changes cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .native_text import NOT_BLANK, window_hashes, words

#: Words of the windows that count as repeated.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over ``text`` and the columns of ``measured``."""

    name: str
    rejects: str


#: Bounds that only junk passes: they reject no running prose.
RULES = (
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("no_letters", r"2 * size(filter(words, w -> not rlike(w, '\\p{L}'))) > n_words"),
    Rule("bangs", "2 * regexp_count(text, '!') > n_words"),
)


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash comes twice or more, from all window hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def doubles(s: Column) -> Column:
        last = F.size(s) - 1
        twin = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])),
        )
        return F.sort_array(F.transform(twin, lambda k: F.get(s, k)["i"]))

    starts = F.get(F.transform(F.array(placed), doubles), F.lit(0))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of whole texts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    first = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("words"), lines.alias("lines"))
    second = first.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.transform("words", lambda w: F.xxhash64(w)), WINDOW).alias("hashes"),
    )
    return second.withColumn("n_repeat_words", repeated_words(F.col("hashes"))).drop("hashes")


def costs(sample: DataFrame, rules: tuple[Rule, ...], repeats: int = 10, runs: int = 3) -> list[float]:
    """Seconds that each rule takes for a pass over ``sample``.

    Every row is judged ``repeats`` times, so that the rule outweighs the job; each
    rule's best of some runs counts, less the best of runs without a rule. The first
    runs warm up the code.
    """
    every = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(rejects: str) -> float:
        best = float("inf")
        for _ in range(runs):
            job = every.agg(F.count_if(F.expr(rejects)))  # a plan that has run keeps its shuffle
            began = time.perf_counter()
            job.collect()
            best = min(best, time.perf_counter() - began)
        return best

    empty = seconds("again < 0")
    # A rule that doesn't show against the noise of jobs costs a thousandth of the empty run.
    return [max(seconds(f"({r.rejects}) and again > 0") - empty, empty / 1000) / repeats for r in rules]


def by_gain(rejected: list[tuple[tuple[bool, ...], int]], cost: list[float]) -> list[int]:
    """Places of rules by rejections per cost, highest first, each on the rows that the rules before it leave.

    ``rejected``: for each pattern of verdicts how many rows have it. Equal gains: the cheaper, then the first.
    """
    order: list[int] = []
    left = list(range(len(cost)))
    while left:
        rows = [(bits, n) for bits, n in rejected if not any(bits[k] for k in order)]
        best = min(left, key=lambda k: (-sum(n for bits, n in rows if bits[k]) / cost[k], cost[k], k))
        order.append(best)
        left.remove(best)
    return order


def ordered(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """``rules`` in the order of their rejections per cost on ``sample``."""
    verdicts = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    counts = sample.groupBy(*verdicts).count().collect()  # as many rows as the rules' verdicts make patterns on the sample
    return [rules[k] for k in by_gain([(tuple(row[: len(rules)]), row["count"]) for row in counts], costs(sample, rules))]


def cascade(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; later rules see only what earlier ones let pass."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 300) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every row.

    About ``sample_rows`` rows, drawn alike from all partitions with their whole
    texts, order the rules; verdicts never depend on them. A null text has no words
    and fails; a null doc_id stays null. Windows are compared by 64-bit hashes. Other
    columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = written(measured(docs.sample(share, seed=1).repartition(8)), "sample")
    order = ordered(sample, rules)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return (
        measured(docs)
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)).alias("kept"),
        )
    )
