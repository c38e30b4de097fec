"""Lookups and verification of drafts: citations, quotes, attribution, sentences and reports.

A draft frame has (draft_id, text). Citations and quotes are exploded rows with
places; every step joins on the draft and keeps what is unresolved for the next.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prints
from ..functions import text as functions
from ..tables import written
from . import scalars
from .search import Index


def resolve(keys: DataFrame, citation_strings: DataFrame, opinions: DataFrame) -> DataFrame:
    """``keys`` (volume, reporter, page) with cluster_id, id, n_clusters and all cluster_ids of the preferred unblocked opinion, or nulls.

    A reporter is tried as it stands, then by its alias. Leads come first, then the lowest id.
    """
    asked = keys.select("volume", "reporter", "page").distinct()
    spelled = asked.select(
        "volume", "reporter", "page", scalars.lookup_number(F.col("volume")).alias("v"), scalars.lookup_page(F.col("page")).alias("p"),
        F.explode(F.array(F.struct(F.lit(0).alias("try"), F.trim("reporter").alias("r")), F.struct(F.lit(1).alias("try"), scalars.reporter(F.col("reporter")).alias("r")))).alias("x"),
    ).select("volume", "reporter", "page", "v", "p", "x.try", "x.r")
    known = citation_strings.select(F.col("volume").alias("v"), F.col("reporter").alias("r"), F.col("page").alias("p"), "cluster_id").distinct()
    owners = opinions.where("not blocked").groupBy("cluster_id").agg(F.min(F.struct(scalars.type_rank(F.col("type")).alias("rank"), "id")).alias("best"))
    found = spelled.join(known, ["v", "r", "p"]).join(owners, "cluster_id")
    best = found.groupBy("volume", "reporter", "page").agg(
        F.min(F.struct("try", "best.rank", "best.id", "cluster_id")).alias("x"), F.collect_set("cluster_id").alias("cluster_ids")
    )
    return keys.join(best, ["volume", "reporter", "page"], "left").withColumns(
        {"cluster_id": F.col("x.cluster_id"), "id": F.col("x.id"), "n_clusters": F.coalesce(F.size("cluster_ids"), F.lit(0)).cast("long")}
    ).drop("x")


def citation_checks(drafts: DataFrame, citation_strings: DataFrame, opinions: DataFrame, authority: DataFrame | None = None) -> DataFrame:
    """A row for each full, short, id, supra or unknown citation of each draft, with its status.

    ``ambiguous``: a verified key that names several clusters, of which the preferred one is
    taken. ``pin_unverified``: there is a pin, which nothing checks. ``corrected``: a full citation
    as the corpus writes it. ``treatment``: labels of the cluster, if ``authority`` (id, flags) is given.
    A draft that can't be read has one row of kind error, unresolved, with the ``error``.
    """
    read = drafts.select("draft_id", functions.citations_of(F.col("text")).alias("x"))
    found = read.select("draft_id", F.posexplode("x.found").alias("idx", "c")).select("draft_id", "idx", "c.*")
    statutes = drafts.select("draft_id", F.explode(functions.statute_citations_of(F.col("text"))).alias("s")).select("draft_id", F.col("s.start").alias("s0"), F.col("s.end").alias("s1"))
    overlapping = found.join(statutes, "draft_id").where("start < s1 and s0 < end").select("draft_id", "idx").distinct()
    checked = resolve(found.join(overlapping, ["draft_id", "idx"], "left_anti"), citation_strings, opinions)
    outside = F.lower(F.regexp_replace("reporter", r"[^A-Za-z]", "")).isin("wl", "westlaw", "lexis", "lexsee")
    status = (
        F.when(F.col("kind") != "full", "unsupported_form")
        .when(F.coalesce(outside, F.lit(False)), "out_of_corpus")
        .when(F.col("id").isNotNull(), "verified")
        .otherwise("unresolved_citation")
    )
    corrected = F.when(F.col("kind") == "full", F.concat_ws(" ", scalars.lookup_number(F.col("volume")), scalars.reporter(F.col("reporter")), scalars.lookup_page(F.col("page"))))
    checked = checked.withColumns({
        "status": status, "ambiguous": (status == "verified") & (F.col("n_clusters") > 1), "pin_unverified": F.col("pin").isNotNull(),
        "corrected": corrected, "error": F.lit(None).cast("string"),
    })
    failed = read.where("x.error is not null").select("draft_id", F.lit("error").alias("kind"), F.lit("unresolved_citation").alias("status"), F.col("x.error").alias("error"))
    checked = checked.unionByName(failed, allowMissingColumns=True)
    if authority is None:
        return checked
    flags = authority.join(opinions.select("id", "cluster_id"), "id").groupBy("cluster_id").agg(F.max("flags").alias("flags"))
    return checked.join(flags, "cluster_id", "left").withColumn("treatment", scalars.treatment_labels(F.coalesce("flags", F.lit(0)))).drop("flags")


def antecedents(checks: DataFrame) -> DataFrame:
    """``checks`` with ``full_idx``: the full citation of the same draft that a short, id or supra form stands for, or null.

    A short form stands for the last full citation before it with its volume and reporter,
    a supra for the last whose case may have its name, and an id for what the citation before it stands for;
    if that stands for nothing, neither does the id. Each draft's citations pass in their order; ids in a row share
    what the first stands for.
    """
    before = lambda *keys: Window.partitionBy("draft_id", *keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("kind") == "full", F.col("idx"))
    same = checks.withColumn("_short", F.last(full, True).over(before("volume", "reporter")))
    told = checks.where(F.col("kind").isin("full", "supra")).select("draft_id", "idx", "kind", F.explode(F.array_distinct("names")).alias("name"))
    supra = told.withColumn("_supra", F.last(full, True).over(before("name"))).where("kind = 'supra'").select("draft_id", "idx", "_supra")
    rows = same.join(supra, ["draft_id", "idx"], "left")
    own = F.when(F.col("kind") == "full", F.col("idx")).when(F.col("kind") == "short", F.col("_short")).when(F.col("kind") == "supra", F.col("_supra"))
    rows = rows.withColumn("_own", own)
    last = F.last(F.when(F.col("kind") != "id", F.struct(F.col("_own").alias("x"))), True).over(before())
    return rows.withColumn("full_idx", F.when(F.col("kind") == "id", last["x"]).otherwise(F.col("_own"))).drop("_short", "_supra", "_own")


def resolve_statutes(keys: DataFrame, statutes: DataFrame) -> DataFrame:
    """``keys`` (source, title, section, ...) with the ``heading`` of the statute of that very key, or null."""
    known = statutes.groupBy("source", "title", "section").agg(F.min("heading").alias("heading"))
    return keys.join(known, ["source", "title", "section"], "left")


def statute_checks(drafts: DataFrame, statutes: DataFrame) -> DataFrame:
    """A row for each statutory citation of each draft: (draft_id, start, end, citation, status, heading)."""
    found = drafts.select("draft_id", F.explode(functions.statute_citations_of(F.col("text"))).alias("s")).select("draft_id", "s.*")
    label = scalars.statute_label(F.col("source"), F.col("title"), F.col("section"))
    status = F.when(F.col("heading").isNotNull(), "verified").otherwise("unresolved_citation")
    return resolve_statutes(found, statutes).select("draft_id", "start", "end", label.alias("citation"), status.alias("status"), "heading")


def lookup(asked: DataFrame, citation_strings: DataFrame, opinions: DataFrame, statutes: DataFrame) -> DataFrame:
    """``asked`` (asked) with what each string names: a case (kind, id) first, else a statute (kind, heading), else nulls."""
    cases = asked.distinct().withColumn("c", scalars.parsed_citation(F.col("asked"))).select("asked", "c.*")
    found = resolve(cases.where("volume is not null"), citation_strings, opinions).where("id is not null").select("asked", "id")
    codes = asked.distinct().select("asked", F.get(functions.statute_citations_of(F.col("asked")), F.lit(0)).alias("s")).where("s is not null").select("asked", "s.*")
    named = resolve_statutes(codes, statutes).where("heading is not null").select("asked", "heading")
    kind = F.when(F.col("id").isNotNull(), "case").when(F.col("heading").isNotNull(), "statute")
    return asked.join(found, "asked", "left").join(named, "asked", "left").select(
        *asked.columns, kind.alias("kind"), "id", F.when(F.col("id").isNull(), F.col("heading")).alias("heading")
    )


def attributed(quotes: DataFrame, checks: DataFrame, ahead: int = 300) -> DataFrame:
    """Each quote (draft_id, start) with the verified citation it belongs to, the last one that ends ``before`` it, else the next within ``ahead``.

    Quotes and citations of a draft pass once in the order of their places.
    """
    of_owner = ["idx", "cluster_id", "id", *[n for n in ("cluster_ids",) if n in checks.columns]]
    owner = F.struct(*of_owner).alias("owner")
    asked = quotes.select("draft_id", "start", "end", F.struct(*quotes.columns).alias("quote"))
    no_quote = F.lit(None).cast(asked.schema["quote"].dataType).alias("quote")
    cites = checks.where("status = 'verified'")
    no_owner = F.lit(None).cast(cites.select(owner).schema["owner"].dataType).alias("owner")
    mine, first = F.col("quote").isNotNull(), Window.partitionBy("draft_id")
    # Citations by their ends, before quotes by their starts; then by their starts, after quotes by their ends.
    ends = cites.select("draft_id", F.col("end").alias("at"), no_quote, owner).unionByName(asked.select("draft_id", F.col("start").alias("at"), "quote", no_owner))
    so_far = first.orderBy("at", mine, "owner.idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = ends.withColumn("before", F.last("owner", True).over(so_far)).where(mine)
    begins = cites.select("draft_id", F.col("start").alias("at"), no_quote, owner).withColumn("before", no_owner)
    rows = begins.unionByName(left.select("draft_id", F.col("quote.end").alias("at"), "quote", no_owner, "before"))
    to_come = first.orderBy(F.desc("at"), mine, F.desc("owner.idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("next", F.last(F.when(F.col("quote").isNull(), F.struct("at", "owner")), True).over(to_come)).where(mine)
    chosen = F.coalesce("before", F.when(F.col("next.at") - F.col("at") <= ahead, F.col("next.owner")))
    return rows.select("quote.*", chosen.alias("owner"), F.col("before").isNotNull().alias("before")).select(*quotes.columns, *[f"owner.{n}" for n in of_owner], "before")


#: Bits by which texts know the fingerprints that are asked for, at most: 8 MB.
BITS = 1 << 26


def _marked(asked: DataFrame) -> np.ndarray:
    """Bits of the fingerprints in ``asked`` (print), sixteen times as many as these, up to BITS."""
    bits = min(BITS, 1 << max(10, (16 * asked.count()).bit_length()))
    bit = F.col("print").bitwiseAND(F.lit(bits - 1))
    words = asked.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("set")).toArrow()
    marked = np.zeros(bits // 64, np.uint64)
    marked[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return marked


def holders(quotes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` (quote_id, quote, print) and ``held`` (print, id): every one of ``texts`` (id, text) that has a quote (quote) is held under its print.

    A text with a quote has all its fingerprints (see ``functions.prints``), so a quote of which any is in no text
    has no holder and isn't known. The others are asked for by the fingerprint that the fewest texts have.
    Texts are read once, by tasks that know which fingerprints are asked for by bits, so what
    leaves them are those of quotes, and few others. Quotes are distinct.
    """
    listed = written(quotes.select("quote").distinct().select(F.monotonically_increasing_id().alias("quote_id"), "quote"), "distinct-quotes")
    asked = written(listed.mapInArrow(prints.of_quotes, "quote_id long, kind int, print long"), "asked")
    kinds = sorted(r["kind"] for r in asked.select("kind").distinct().collect())
    found = texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(prints.of_texts(kinds, _marked(asked)), "print long, id long")
    found = written(found, "prints")
    n = found.groupBy("print").agg(F.count("*").alias("n"))
    rarest = asked.join(n.hint("merge"), "print", "left").groupBy("quote_id").agg(F.min(F.struct("n", "print")).alias("x"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    known = written(listed.join(rarest.where("whole").select("quote_id", "x.print").hint("merge"), "quote_id"), "known-quotes")
    return known, written(found.join(known.select("print").hint("merge"), "print", "left_semi"), "held")


def true_sources(known: DataFrame, held: DataFrame, texts: DataFrame, ranks: DataFrame, first: int = 16) -> DataFrame:
    """(quote_id, source_id): for quotes and holders of ``holders`` the one of ``texts`` (id, text) that has the quote, the best by ``ranks`` (id, highest, pagerank).

    A quote is read for in its holders in the order of their ranks: in the ``first`` ones, then, if none has it,
    in sixteen times as many, until one has it or all have been read.
    """
    best = Window.partitionBy("print").orderBy(F.desc("highest"), F.desc("pagerank"), "id")
    of = held.join(texts.select("id").distinct().hint("merge"), "id").join(ranks.select("id", F.coalesce("highest", F.lit(False)).alias("highest"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).hint("merge"), "id", "left")
    of = of.withColumns({"highest": F.coalesce("highest", F.lit(False)), "pagerank": F.coalesce("pagerank", F.lit(0.0))})
    placed = written(of.select("print", "id", F.row_number().over(best).alias("nth")), "placed")
    left, sources, low, high = known, [], 0, first
    while True:
        pairs = left.join(placed.where((F.col("nth") > low) & (F.col("nth") <= high)).hint("merge"), "print").select("quote_id", "quote", "id", "nth")
        hit = pairs.join(texts.select("id", "text").hint("merge"), "id").where(functions.find_quote_of(F.col("text"), F.col("quote"))["how"].isNotNull())
        sources.append(written(hit.groupBy("quote_id").agg(F.min_by("id", "nth").alias("source_id")), "sources"))
        more = placed.where(F.col("nth") == high + 1).select("print")
        left = written(left.join(more.hint("merge"), "print", "left_semi").join(sources[-1].hint("merge"), "quote_id", "left_anti"), "left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, sources)
        low, high = high, 16 * high


def _owned(quotes: DataFrame, checks: DataFrame, drafts: DataFrame, statutes: DataFrame | None) -> DataFrame:
    """Quotes with the case, or the statute by ``statute_id``, that they belong to: a statute before it, a case before it, a case after it, a statute after it."""
    cases = attributed(quotes, checks)
    if statutes is None:
        return cases.drop("before").withColumn("statute_id", F.lit(None).cast("long"))
    found = drafts.select("draft_id", F.posexplode(functions.statute_citations_of(F.col("text"))).alias("idx", "s")).select("draft_id", "idx", "s.*")
    known = statutes.groupBy("source", "title", "section").agg(F.min("id").alias("id"))
    cited = found.join(known, ["source", "title", "section"]).select("draft_id", "start", "end", "idx", F.lit(None).cast("long").alias("cluster_id"), "id", F.lit("verified").alias("status"))
    codes = attributed(quotes, cited).select("draft_id", "start", F.col("id").alias("_statute"), F.col("before").alias("_before"))
    both = cases.join(codes, ["draft_id", "start"])
    own = F.when(F.col("_before") | (~F.col("before") & F.col("id").isNull()), F.col("_statute"))
    both = both.withColumn("statute_id", own)
    case = [n for n in ("idx", "cluster_id", "id", "cluster_ids") if n in cases.columns]
    return both.withColumns({n: F.when(F.col("statute_id").isNull(), F.col(n)) for n in case}).drop("before", "_statute", "_before")


def quote_checks(
    drafts: DataFrame, checks: DataFrame, opinions: DataFrame, index: Index | None = None, ranks: DataFrame | None = None, statutes: DataFrame | None = None
) -> DataFrame:
    """Each quote of each draft with its verdict: verified, within_cluster, wrong_case (with its ``source_id``), not_found or unattributed.

    With ``statutes`` (id, source, title, section, text) a quote may belong to one, whose text is then read.

    What its own case doesn't have is sought by fingerprints in all other opinions (see ``holders``): siblings are those
    of all clusters that the key names; the true source is any searchable opinion that has the quote, the best by
    ``ranks``, and is sought if these are given. No ``index`` is read for that. No table that grows with drafts or
    opinions is broadcast.
    """
    quotes = drafts.select("draft_id", F.explode(functions.quoted_spans_of(F.col("text"))).alias("q")).select("draft_id", "q.*")
    owned = _owned(quotes, checks, drafts, statutes)
    texts = opinions.where("not blocked").select("id", "cluster_id", "text")
    tried = owned.join(texts.select("id", "text").hint("merge"), "id", "left")
    if statutes is not None:
        tried = tried.join(statutes.select(F.col("id").alias("statute_id"), F.col("text").alias("_code")).hint("merge"), "statute_id", "left").withColumn("text", F.coalesce("_code", "text")).drop("_code")
    tried = tried.withColumn("hit", functions.find_quote_of(F.col("text"), F.col("quote"))).drop("text")
    first = written(tried.withColumn("status", F.when(F.col("id").isNull() & F.col("statute_id").isNull(), "unattributed").when(F.col("hit.how").isNotNull(), "verified")), "quotes")
    known, held = holders(first.where("status is null").select("quote"), texts)
    rest = first.where("status is null").select("draft_id", "start", "quote", "id", F.explode(F.array_distinct("cluster_ids")).alias("cluster_id")).join(known.hint("merge"), "quote")
    placed = held.join(texts.select("id", "cluster_id").hint("merge"), "id").select("print", F.col("id").alias("own"), "cluster_id")
    siblings = rest.join(placed.hint("merge"), ["print", "cluster_id"]).where("own <> id").select("draft_id", "start", "quote", "own")
    siblings = siblings.join(texts.select(F.col("id").alias("own"), "text").hint("merge"), "own").where(functions.find_quote_of(F.col("text"), F.col("quote"))["how"].isNotNull())
    found = siblings.select("draft_id", "start", F.lit(True).alias("sibling")).distinct()
    done = first.join(found.hint("merge"), ["draft_id", "start"], "left").withColumn("status", F.coalesce("status", F.when(F.col("sibling"), "within_cluster")))
    if ranks is None:
        done = done.withColumn("source_id", F.lit(None).cast("long"))
    else:
        done = written(done, "quotes")
        open_ = known.join(done.where("status is null").select("quote").hint("merge"), "quote", "left_semi")
        sources = true_sources(open_, held, opinions.where(scalars.searchable()).select("id", "text"), ranks)
        sources = known.join(sources.hint("merge"), "quote_id").select("quote", "source_id")
        done = done.join(sources.hint("merge"), "quote", "left").withColumn("source_id", F.when(F.col("status").isNull(), F.col("source_id")))
    status = F.coalesce("status", F.when(F.col("source_id").isNotNull(), "wrong_case").otherwise("not_found"))
    return done.select("draft_id", "quote", "start", "end", "idx", "id", status.alias("status"), F.col("hit.how").alias("how"), "source_id", "statute_id")


def all_checks(checks: DataFrame, statutes: DataFrame | None) -> DataFrame:
    """(draft_id, start, end, kind, status) of case citations and, if given, of ``statute_checks``."""
    names = ["draft_id", "start", "end", "kind", "status"]
    return checks.select(names) if statutes is None else checks.select(names).unionByName(statutes.withColumn("kind", F.lit("statute")).select(names))


def report(drafts: DataFrame, checks: DataFrame, quotes: DataFrame, statutes: DataFrame | None = None) -> DataFrame:
    """(draft_id, n_citations, n_quotes, n_bad, overall, summary) of every draft: ``verified`` unless anything failed, ``empty`` without checks.

    A citation fails if the corpus should have it and doesn't, so neither one of an
    unsupported form nor one of another corpus; ``statutes`` (of ``statute_checks``) count as
    citations. ``summary`` counts checks by kind and status.
    """
    known = all_checks(checks, statutes)
    c = known.groupBy("draft_id").agg(F.count("*").alias("n_citations"), F.count_if(F.col("status") == "unresolved_citation").alias("bad_citations"))
    q = quotes.groupBy("draft_id").agg(F.count("*").alias("n_quotes"), F.count_if(~F.col("status").isin("verified", "within_cluster")).alias("bad_quotes"))
    named = known.select("draft_id", F.concat_ws(":", F.when(F.col("kind") == "statute", "statute").otherwise("citation"), "status").alias("name"))
    named = named.unionByName(quotes.select("draft_id", F.concat_ws(":", F.lit("quote"), "status").alias("name")))
    counts = named.groupBy("draft_id", "name").agg(F.count("*").alias("n")).groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("counts"))
    none = F.lit(0)
    rows = drafts.select("draft_id").join(c, "draft_id", "left").join(q, "draft_id", "left").join(counts, "draft_id", "left")
    bad = F.coalesce("bad_citations", none) + F.coalesce("bad_quotes", none)
    both = F.coalesce("n_citations", none) + F.coalesce("n_quotes", none)
    return rows.select(
        "draft_id", F.coalesce("n_citations", none).alias("n_citations"), F.coalesce("n_quotes", none).alias("n_quotes"), bad.alias("n_bad"),
        F.when(both == 0, "empty").when(bad == 0, "verified").otherwise("failed").alias("overall"),
        F.coalesce(F.array_join(F.transform("counts", lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), " "), F.lit("")).alias("summary"),
    )


def export_gate(drafts: DataFrame, citation_strings: DataFrame, opinions: DataFrame, statutes: DataFrame | None = None) -> DataFrame:
    """(draft_id, citation) of citations in drafts, statutory ones too if ``statutes`` are given, that don't resolve; a draft without rows may be exported."""
    listed = drafts.select("draft_id", F.explode(scalars.inline_citations(F.col("text"))).alias("citation"))
    parsed = listed.withColumn("c", scalars.parsed_citation(F.col("citation"))).where("c is not null").select("draft_id", "citation", "c.*")
    missing = resolve(parsed, citation_strings, opinions).where("id is null").select("draft_id", "citation")
    if statutes is not None:
        missing = missing.unionByName(statute_checks(drafts, statutes).where("status = 'unresolved_citation'").select("draft_id", "citation"))
    return missing.distinct()


def drafted(sentences: DataFrame) -> DataFrame:
    """(draft_id, text) of tagged sentences (draft_id, n, tag, text, pin): each with its tag before and its pin citation after it."""
    said = F.concat(F.lit("["), F.col("tag"), F.lit("] "), F.col("text"), F.coalesce(F.concat(F.lit(" ("), F.col("pin"), F.lit(")")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("n", said.alias("said"))))
    return sentences.groupBy("draft_id").agg(F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"))


def sentence_verdicts(sentences: DataFrame, checks: DataFrame, quotes: DataFrame) -> DataFrame:
    """Sentences (draft_id, n, tag, text, pin) with their range in the draft, what stands in it, and whether all of that is verified.

    Sentences, checks and quotes of a draft pass once in the order of their places: each
    check belongs to the last sentence begun, if it ends there too. A LAW sentence needs a
    pin citation, and one in which a citation was found. ``reason`` is the first that fails:
    a check's status, ``no pin`` or ``pin without citation``.
    """
    w = Window.partitionBy("draft_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    head, size = F.length("tag") + 3, F.length("text") + F.coalesce(F.length("pin") + 3, F.lit(0))
    ranged = sentences.withColumn("s0", (F.coalesce(F.sum(head + size + 1).over(w), F.lit(0)) + head).cast("int")).withColumn("s1", (F.col("s0") + size).cast("int"))
    found = checks.select("draft_id", "start", "end", F.lit("cite").alias("what"), "status").unionByName(quotes.select("draft_id", "start", "end", F.lit("quote").alias("what"), "status"))
    begun = ranged.select("draft_id", F.col("s0").alias("at"), F.struct("n", "s1").alias("s"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("what"), F.lit(None).cast("string").alias("status"))
    so_far = Window.partitionBy("draft_id").orderBy("at", F.col("what").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begun.unionByName(found.where("start is not null").select("draft_id", F.col("start").alias("at"), F.lit(None).cast(begun.schema["s"].dataType).alias("s"), "end", "what", "status"))
    inside = both.withColumn("s", F.last("s", True).over(so_far)).where("what is not null and end <= s.s1").select("draft_id", "s.n", "at", "what", "status")
    bad = F.when(~F.col("status").isin("verified", "within_cluster"), F.struct("at", F.concat_ws(":", "what", "status").alias("reason")))
    of = inside.groupBy("draft_id", "n").agg(F.count_if(F.col("what") == "cite").alias("n_cites"), F.count_if(F.col("what") == "quote").alias("n_quotes"), F.min(bad).alias("bad"))
    rows = ranged.join(of, ["draft_id", "n"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_cites", "n_quotes")})
    law = F.col("tag") == "LAW"
    reason = F.coalesce(F.col("bad.reason"), F.when(law & F.col("pin").isNull(), "no pin"), F.when(law & (F.col("n_cites") == 0), "pin without citation"))
    return rows.select("draft_id", "n", "tag", "s0", "s1", "n_cites", "n_quotes", reason.isNull().alias("verified"), reason.alias("reason"))


def drafts_passed(verdicts: DataFrame, reports: DataFrame) -> DataFrame:
    """(draft_id, n_sentences, n_unverified, passed): a draft passes if its report and all its sentences do."""
    of = verdicts.groupBy("draft_id").agg(F.count("*").alias("n_sentences"), F.count_if(~F.col("verified")).alias("n_unverified"))
    rows = of.join(reports.select("draft_id", "overall"), "draft_id")
    return rows.select("draft_id", "n_sentences", "n_unverified", ((F.col("n_unverified") == 0) & (F.col("overall") != "failed")).alias("passed"))
