"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host and path with the literal tokens
that any match holds whole. Token frequencies over all URLs choose the rarest
one as the rule's index key. A URL's tokens fetch candidate rules from the index,
and only these run their expression; rules without a literal token are candidates
of every URL. Of the rules that match, the longest wins. Rules are a parameter, so
the index goes to every task and no URL is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

#: What a token is, in rules and URLs alike.
TOKEN = r"[^./\-_?&=#:+~,;!@%]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path, joined; ``tokens`` are in every match, bounded by separators; longer ``weight`` wins."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains, where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    tokens = re.findall(TOKEN, host)
    # The last token of the path may be a part of the URL's, unless a separator ends it.
    tokens += re.findall(TOKEN, path)[: None if re.search(f"^$|(?!{TOKEN}).$", path) else -1]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}" + (re.escape(slash + path) if slash else r"(?:/|\Z)")
    return Rule(rule, verdict, pattern, tuple(t.lower() for t in tokens), len(rule))


def words_rule(verdict: str, name: str, words: tuple[str, ...]) -> Rule:
    """A host label made of ``words`` with hyphens; its name isn't returned as a listed rule."""
    label = "-".join(map(re.escape, words))
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{label}\.[^/]*(?:/|\Z)", words, 0, False)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path: empty where the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rarest_tokens(addresses: DataFrame, rules: list[Rule]) -> list[str | None]:
    """For each rule its literal token that the fewest ``at`` of ``addresses`` have; None without a token."""
    literal = sorted({t for r in rules for t in r.tokens})
    if not literal:
        return [None] * len(rules)
    found = addresses.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("at"), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    known = addresses.sparkSession.createDataFrame([(t,) for t in literal], "token string")
    counts = found.join(F.broadcast(known), "token", "left_semi").groupBy("token").count().collect()  # the rules' tokens at most
    n = {r["token"]: r["count"] for r in counts}
    return [min(r.tokens, key=lambda t: (n.get(t, 0), t), default=None) for r in rules]


def _judge(rules: list[Rule], keys: list[str | None], default: str):
    """Rows (id, host, path) with rule and verdict."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The longest rule first, of equals the earlier one: the first that fits wins.
        order = sorted(range(len(rules)), key=lambda k: (-rules[k].weight, k))
        compiled = [re.compile(rules[k].pattern) for k in order]
        index: dict[str | None, list[int]] = {}
        for place, k in enumerate(order):
            index.setdefault(keys[k], []).append(place)
        always = index.get(None, [])
        split = re.compile(TOKEN).findall
        for part in parts:
            found, verdicts = [], []
            for host, path in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                at = host + path
                fetched = {p for token in {*split(at.lower())} for p in index.get(token, ())}
                best = next((p for p in sorted(fetched.union(always)) if compiled[p].search(at)), None)
                rule = None if best is None else rules[order[best]]
                found.append(rule.rule if rule and rule.listed else None)
                verdicts.append(rule.verdict if rule else default)
            yield from batches([(*part.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string()))], [*part.schema.names, "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages``.

    ``rule`` is null and the verdict an unlisted rule's or the ``default`` where
    no listed rule fits. A null URL or one without ``://`` has an empty host and
    path. Rows that repeat a page_id are judged one by one. Equal weights: the
    first rule. Other columns are ignored.
    """
    host, path = address(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = rarest_tokens(urls.select(F.concat("host", "path").alias("at")), rules)
    kind = pages.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(_judge(rules, keys, default), f"page_id {kind}, host string, path string, rule string, verdict string")
