"""Scalar coercions, normalizers and text predicates as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of reporters that differ from the stored ones (fixed values).
REPORTER_ALIASES = {
    "u.s.": "U.S.",
    "us": "U.S.",
    "f.2d": "F.2d",
    "f.3d": "F.3d",
    "f.4th": "F.4th",
    "s.ct.": "S. Ct.",
}

#: Patterns of treatment language and their bits (fixed values): overruled 1, abrogated 2, distinguished 4, but see 8, declined to follow 16.
TREATMENT_BITS = (
    (r"\boverrul|\bdisapprov|\bsupersed|\bdepart\w* from\b|\bno longer (good law|controlling|followed|valid)\b", 1),
    (r"abrogat", 2),
    (r"distinguish", 4),
    (r"\bbut see\b", 8),
    (r"\bdeclined to follow\b", 16),
)
TREATMENT_LABELS = {1: "overruled", 2: "abrogated", 4: "distinguished", 8: "but_see", 16: "declined_to_follow"}


def safe_int(x: Column, default: int | None = None) -> Column:
    """Trimmed whole number, else ``default``."""
    n = F.trim(x).try_cast("bigint")
    return n if default is None else F.coalesce(n, F.lit(default))


def safe_bool(x: Column) -> Column:
    """1 for t, T, true, True and 1 after trimming, else 0."""
    return F.coalesce(F.trim(x).isin("t", "T", "true", "True", "1"), F.lit(False)).cast("int")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_non_blank(columns: list[str]) -> Column:
    """Struct (source, value) of the first column that isn't blank; null if all are."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.struct(F.lit(c).alias("source"), F.col(c).alias("value"))) for c in columns])


def etl_volume(volume: Column) -> Column:
    return F.coalesce(safe_int(volume).cast("string"), F.trim(volume))


def etl_page(page: Column) -> Column:
    """Whole number, else its digits only."""
    return F.coalesce(safe_int(page).cast("string"), F.regexp_replace(page, "[^0-9]", ""))


def lookup_number(x: Column) -> Column:
    """A finite number's truncated text, else the trimmed input."""
    t = F.trim(x)
    n = t.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(t)


def lookup_page(page: Column) -> Column:
    lead = F.regexp_extract(F.trim(page), r"^(\d+)", 1)
    return F.when(lead != "", lookup_number(lead)).otherwise(lookup_number(page))


def reporter(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in REPORTER_ALIASES.items() for v in pair])
    t = F.trim(x)
    return F.coalesce(F.try_element_at(table, F.lower(t)), t)


def type_rank(kind: Column) -> Column:
    """Leads first, then combined opinions, then all others."""
    return F.when(kind.contains("lead"), 0).when(kind.contains("combined"), 1).otherwise(2)


def yyyymmdd(date: Column) -> Column:
    """Date text as a number; 0 unless ten characters with a year from 1600 to 2026."""
    year = F.substring(date, 1, 4).try_cast("int")
    whole = F.regexp_replace(date, "-", "").try_cast("int")
    return F.coalesce(F.when((F.length(date) == 10) & year.between(1600, 2026), whole), F.lit(0))


def treatment_bits(context: Column) -> Column:
    """Bitmask of treatment language; 0 for null."""
    low = F.lower(context)
    total = F.lit(0)
    for pattern, bit in TREATMENT_BITS:
        total = total + F.when(low.rlike(pattern), bit).otherwise(0)
    return F.coalesce(total, F.lit(0))


def treatment_labels(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, name) for b, name in TREATMENT_LABELS.items()]))


def statute_label(source: Column, title: Column, section: Column) -> Column:
    """A statute's key as it is cited: ``42 U.S.C. § 1983`` or ``12 C.F.R. § 1026.36``."""
    return F.concat(title, F.when(source == "usc", " U.S.C. § ").when(source == "ecfr", " C.F.R. § ").otherwise(F.concat(F.lit(" "), source, F.lit(" § "))), section)


#: Language by which a citer turns against what it cites (fixed values).
NEGATIVE = ("overrul", "abrogat", "but see", "declined to follow", "no longer")


def negative(context: Column) -> Column:
    return reduce(or_, (F.lower(context).contains(t) for t in NEGATIVE))


def collapsed(text: Column) -> Column:
    """White space, Unicode's too, as single blanks; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def searchable(status: str = "status", blocked: str = "blocked") -> Column:
    """Published or of unknown status, and not blocked."""
    return F.col(status).isin("Published", "Unknown") & ~F.col(blocked)


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _only(x: Column, characters: str) -> Column:
    return F.translate(x, characters, "") == ""


def _number(x: Column, most: int) -> Column:
    return _only(x, _DIGITS) & F.length(x).between(1, most)


def parsed_citation(x: Column) -> Column:
    """Struct (volume, reporter, page) of a text whose first word is a volume and whose last is a page, with a reporter's words between; else null."""
    plain = lambda number: number.try_cast("int").cast("string")

    def read(words: Column) -> Column:
        n = F.size(words)
        volume, page = F.get(words, F.lit(0)), F.get(words, n - 1)
        name = F.array_join(F.slice(words, 2, F.greatest(n - 2, F.lit(0))), " ")
        named = _only(F.lower(name), _LETTERS + _DIGITS + " .'") & _only(F.lower(F.substring(name, 1, 1)), _LETTERS)
        whole = (n >= 3) & _number(volume, 4) & _number(page, 6) & named
        return F.when(whole, F.struct(plain(volume).alias("volume"), name.alias("reporter"), plain(page).alias("page")))

    return F.get(F.transform(F.array(F.split(F.trim(x), r"\s+")), read), F.lit(0))


def inline_citations(text: Column) -> Column:
    """Distinct case citations in a text: a volume, one to five words of a reporter, of which the first is a capital and one has a period, and a page.

    Words are those between blanks, without punctuation around them. The nearest page ends a citation.
    """
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[,;:!?)\]\"'”’]+$", "")
    words = F.transform(F.split(F.trim(text), r"\s+"), bare)

    def at(ws: Column, i: Column) -> Column:
        page = lambda k: F.rtrim(F.get(ws, i + k + 1), F.lit("."))
        names = lambda k: F.slice(ws, i + 2, k)
        named = lambda k: F.forall(names(k), lambda w: _only(F.lower(w), _LETTERS + ".'") & (w != ""))
        capital = _only(F.substring(F.get(ws, i + 1), 1, 1), _LETTERS.upper())
        sizes = F.filter(F.array(*map(F.lit, range(1, 6))), lambda k: _number(page(k), 6) & named(k))
        cite = F.transform(F.slice(sizes, 1, 1), lambda k: F.concat_ws(" ", F.get(ws, i), F.array_join(names(k), " "), page(k)))
        return F.when(_number(F.get(ws, i), 4) & capital, F.get(cite, F.lit(0)))

    # Bound by a lambda, the words are made once.
    found = F.get(F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: at(ws, i))), F.lit(0))
    return F.array_distinct(F.filter(found, lambda c: c.contains(".")))


def context_window(text: Column, start: Column, end: Column, pad: int = 150, most: int = 600) -> Column:
    """What stands ``pad`` characters before and after ``[start, end)``, joined and capped."""
    low = F.greatest(start - pad, F.lit(0))
    before = F.trim(F.substring(text, low + 1, start - low))
    after = F.trim(F.substring(text, end + 1, F.lit(pad)))
    return F.substring(F.concat(before, F.lit(" … "), after), 1, most)


def probe_words(quote: Column) -> Column:
    """Words of a quote that hold a letter or digit, in lower case with straight quotes."""
    plain = F.translate(F.lower(quote), "‘’“”", "''\"\"")
    return F.regexp_extract_all(plain, F.lit(r"(\S*[a-z0-9]\S*)"), F.lit(1))


def middle(words: Column, most: int = 10) -> Column:
    """Up to ``most`` words around the middle of an array, without its first and last one; all of four words or fewer."""
    n = F.size(words)
    taken = F.least(F.lit(most), n - 2)
    return F.when(n <= 4, words).otherwise(F.slice(words, F.greatest(F.lit(2), F.floor((n - taken) / 2).cast("int") + 1), F.greatest(taken, F.lit(0))))


def longest(words: Column, most: int) -> Column:
    """The ``most`` longest distinct words, equal lengths in the order of the alphabet."""
    keyed = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, most), lambda x: x["w"])


#: Marks that go in pairs wherever they stand, longest first.
_PAIRED = ("***", "**", "__", "`")


def without_markup(text: Column) -> Column:
    """Presentation marks removed line by line: headings, bullets, numbering, bold, italics, code; extra blank lines.

    A paired mark goes from a line if it opens and closes there as often. Single asterisks and
    underlines go around a word or phrase, not between numbers or inside a word.
    """

    def unpaired(line: Column, mark: str) -> Column:
        parts = F.split(line, "\\Q" + mark + "\\E")
        return F.when(F.size(parts) % 2 == 1, F.array_join(parts, "")).otherwise(line)

    def plain(line: Column) -> Column:
        line = F.regexp_replace(line, r"^(#+|[*+-]|\d+[).])\h+", "")
        for mark in _PAIRED:
            line = unpaired(line, mark)
        return F.regexp_replace(line, r"(?<![\w*_])([*_])([^\s*_](?:[^*_]*[^\s*_])?)\1(?![\w*_])", "$2")

    lines = F.transform(F.split(text, "\n"), plain)
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def content_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters or digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def overlap(tokens: Column, facts: Column) -> Column:
    """Share of tokens, repeated ones counted each time, that the facts have; null without tokens."""
    common = F.array_intersect(tokens, facts)
    return F.try_divide(F.size(F.filter(tokens, lambda t: F.array_contains(common, t))), F.size(tokens))


def sentences(text: Column) -> Column:
    """Sentences: cuts after a full stop, question or exclamation mark before a capital, quote or bracket."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z\"“(])"), lambda s: s != "")


def known_tag(tag: Column) -> Column:
    """RECORD, LAW or INFERRED as it stands; null for any other tag, whose sentences are rejects."""
    return F.when(tag.isin("RECORD", "LAW", "INFERRED"), tag)


def cleaned_query(text: Column) -> Column:
    """A query without a leading gerund, inline citations and Id."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^[a-z]+ing\s+(?:that\s+)?", "")
    bare = F.regexp_replace(bare, r"\b\d{1,4}\s+[A-Z][A-Za-z.']*\.[A-Za-z0-9.' ]*?\s*\d{1,6}\b|\bId\.", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
