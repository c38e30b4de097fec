"""Text work that expressions can't do, as helpers of one value and Arrow-batched UDFs over columns."""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# ---------------------------------------------------------------- mark-up to text

_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_LINK = re.compile(r'<a\b[^>]*?href="([^"]*)"[^>]*>|(</a\s*>)', re.I | re.S)
_TAG = re.compile(r"<[^<>]+>")
_BLANK = re.compile(r"\s+")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
#: A link to an opinion, and a link to any page by its last path segment.
OPINION_LINK = r"/opinion/(\d+)"
PATH_LINK = r"^/([^/?#\"]+)"


def _entity(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


def _plain(markup: str, whole: bool) -> str:
    bare = _TAG.sub(" ", markup)
    return _ENTITY.sub(_entity, bare) if whole else html.unescape(bare)


def clean_markup(markup: str | None, link: str = OPINION_LINK, whole: bool = False) -> tuple[str, list[dict]]:
    """Text of HTML or XML, and its links as (target, start, end) with ``text[start:end]`` the link's text.

    Comments, scripts, styles and tags become blanks, entities characters, white
    space one blank. Every mention of a target is kept. Text with a NUL inside a
    link keeps no links. With ``whole`` only entities that end in a semicolon count: what a
    cut has left of one stays as it is.
    """
    if not markup:
        return "", []
    source = _DROPPED.sub(" ", markup)
    parts: list[str] = []
    links: list[tuple[str, int, int]] = []  # places in the list of parts
    opened: tuple[str, int] | None = None
    at = 0
    damaged = False
    for m in _LINK.finditer(source):
        if m[2] is None:
            target = re.search(link, m[1])
            if target is None or opened is not None:
                continue
            parts.append(_plain(source[at : m.start()], whole))
            opened, at = (target[1], len(parts)), m.end()
        elif opened is not None:
            inner = source[at : m.start()]
            damaged |= "\x00" in inner
            parts.append(_plain(inner, whole))
            links.append((opened[0], opened[1], len(parts) - 1))
            opened, at = None, m.end()
    parts.append(_plain(source[at:], whole))

    out: list[str] = []
    size = 0
    spans: dict[int, tuple[int, int]] = {}
    blank = True  # what comes before: nothing at the start, or a blank
    for k, part in enumerate(parts):
        start = None
        for piece in re.split(r"(\s+)", part):
            if not piece:
                continue
            if piece.isspace():
                if not blank:
                    out.append(" ")
                    size += 1
                    blank = True
                continue
            start = size if start is None else start
            out.append(piece)
            size += len(piece)
            blank = False
        end = size - 1 if blank and start is not None and size > start else size
        spans[k] = (size, size) if start is None else (start, end)
    text = "".join(out)
    trimmed = text.rstrip()
    found = [] if damaged else [
        {"target": t, "start": min(spans[k][0], len(trimmed)), "end": min(spans[k][1], len(trimmed))} for t, k, _ in links
    ]
    return trimmed, [f for f in found if not (f["target"].isdigit() and int(f["target"]) <= 0)]


# ------------------------------------------------------------------ citations

#: Codes by their letters, with and without periods (fixed values).
CODES = {"USC": "usc", "USCA": "usc", "CFR": "ecfr", "CFRA": "ecfr"}
_CAPITALS = re.compile(r"[A-Z][A-Z.]+")
#: Words of a reporter after its first: names, and ordinals of series.
_MORE = r"(?:\s+(?!Id\.)(?:[A-Za-z][A-Za-z0-9.']*|\d{1,2}(?:d|st|nd|rd|th)\.?)){0,4}?"
_FULL = re.compile(rf"\b(\d{{1,4}})\s+([A-Z][A-Za-z0-9.']*{_MORE})\s+(\d{{1,6}})\b(?:,\s+(\d{{1,6}}(?:-\d{{1,6}})?))?")
_SHORT = re.compile(rf"\b(\d{{1,4}})\s+([A-Z][A-Za-z0-9.']*{_MORE}),?\s+at\s+(\d{{1,6}})\b")
_ID = re.compile(r"\b[Ii]d\.(?:\s+at\s+(\d{1,6}))?")
_SUPRA = re.compile(r"\bsupra\b(?:,?\s+at\s+(\d{1,6}))?")


def _digits(text: str, at: int, most: int | None = None) -> int:
    """Where a run of digits from ``at`` ends, of up to ``most`` if that is given."""
    end = at
    while end < len(text) and (most is None or end - at < most) and text[end].isdecimal():
        end += 1
    return end


def statute_citations(text: str | None) -> list[dict]:
    """Full statutory citations with their places; a subsection isn't part of the section.

    From the name of a code one looks left for a title of three digits at most, and
    right, past blanks and section signs, for a section: digits, a letter, and digits after a period.
    The digits are all that stand there, since a part of a number would name another section.
    """
    text = text or ""
    out = []
    for m in _CAPITALS.finditer(text):
        source = CODES.get(m[0].replace(".", ""))
        left = text[max(0, m.start() - 24) : m.start()]
        number = left.rstrip()
        title = number[len(number.rstrip("0123456789")) :]
        if source is None or number == left or not 0 < len(title) <= 3:
            continue
        at = m.end()
        while at < len(text) and (text[at] == "§" or text[at].isspace()):
            at += 1
        end = _digits(text, at)
        if at == m.end() or end == at:
            continue
        if end < len(text) and text[end].isascii() and text[end].isalpha():
            end += 1
        if text[end : end + 1] == "." and _digits(text, end + 1, 4) > end + 1:
            end = _digits(text, end + 1, 4)
        out.append({"source": source, "title": title, "section": text[at:end], "start": m.start() - len(left) + len(number) - len(title), "end": end})
    return out


#: A section mark of no known code.
_UNKNOWN = re.compile(r"§+\s*\d+")
_NAME = re.compile(r"[^\W\d_][\w'’-]*")


def _before(text: str, at: int, most: int = 80) -> list[str]:
    """Capitalised words in the sentence before a place, nearest first."""
    part = re.split(r"[;!?]|\.\s(?=[A-Z])(?<!v\.\s)", text[max(0, at - most) : at])[-1]
    return [w for w in reversed(_NAME.findall(part)) if w[0].isupper()]


def citations(text: str | None) -> list[dict]:
    """Citations by kind (full, short, id, supra, unknown) in order, none overlapping; reporters have a period.

    ``names``: what a full citation's case may be called, and the name before a supra.
    A text with a NUL is damaged and an error.
    """
    text = text or ""
    if "\x00" in text:
        raise ValueError("NUL in a text")
    found = []
    for kind, pattern in (("short", _SHORT), ("full", _FULL), ("id", _ID), ("supra", _SUPRA), ("unknown", _UNKNOWN)):
        for m in pattern.finditer(text):
            g = m.groups()
            if kind in ("full", "short") and "." not in g[1]:
                continue
            volume, reporter, page = (g[0], g[1], g[2]) if kind in ("full", "short") else (None, None, None)
            pin = g[3] if kind == "full" else g[2] if kind == "short" else g[0] if g else None
            names = _before(text, m.start()) if kind == "full" else _before(text, m.start(), 40)[:1] if kind == "supra" else []
            found.append({"kind": kind, "volume": volume, "reporter": reporter, "page": page if kind == "full" else None, "pin": pin, "names": names, "start": m.start(), "end": m.end()})
    found.sort(key=lambda c: (c["start"], -c["end"]))
    out, end = [], 0
    for c in found:
        if c["start"] >= end:
            out.append(c)
            end = c["end"]
    return out


# ---------------------------------------------------------------------- quotes

#: What stands before an opening and after a closing single quote, besides the ends of a text (fixed values).
_OPENS_AFTER = " \t\n\r([{'\"‘“—–-"
_CLOSES_BEFORE = " \t\n\r.,;:!?)]}\"’”—–-"
_MARKS = re.compile("[\"“”'‘’]")


def quoted_spans(text: str | None) -> list[dict]:
    """Quoted spans by start: double quotes of 8 to 2000 characters, and guarded single quotes of 12 to 2000 with a blank.

    A double quote ends at the next double mark. A single one ends at the next mark
    that may close, and doesn't count inside a double one.
    """
    text = text or ""
    doubles: list[tuple[int, int]] = []
    openers, closers = [], []
    opened = -1
    for m in _MARKS.finditer(text):
        at, mark = m.start(), m[0]
        if mark in "'‘’":
            if at == 0 or text[at - 1] in _OPENS_AFTER:
                openers.append(at)
            if at + 1 == len(text) or text[at + 1] in _CLOSES_BEFORE:
                closers.append(at)
        elif opened >= 0 and mark != "“" and 8 <= at - opened - 1 <= 2000:
            doubles.append((opened, at))
            opened = -1
        else:
            opened = -1 if mark == "”" else at
    starts = [a for a, _ in doubles]
    spans = list(doubles)
    for a in openers:
        k = bisect_right(closers, a)
        if k == len(closers) or not 12 < closers[k] - a <= 2001 or not _BLANK.search(text, a + 1, closers[k]):
            continue
        outer = bisect_right(starts, a) - 1
        if outer < 0 or doubles[outer][1] < closers[k]:
            spans.append((a, closers[k]))
    return [{"quote": text[a + 1 : b], "start": a + 1, "end": b} for a, b in sorted(spans)]


def unquoted(text: str | None) -> str | None:
    """A text with blanks in place of what stands in its quotes, so that all other places stay."""
    for q in quoted_spans(text):
        text = text[: q["start"]] + " " * (q["end"] - q["start"]) + text[q["end"] :]
    return text


#: Characters that stand for each other, and that don't count, in quotes (fixed values).
ALIKE = ("'‘’‚‛", '"“”„', "-–—−")
SOFT = "\u00ad"
NEGATORS = ("no", "not", "never", "none", "neither", "nor", "cannot")
_CLASS = {c: f"[{group}]" if group[0] != "-" else f"[{group[1:]}-]" for group in ALIKE for c in group}
_LEFT_OUT = re.compile(rf"(?:^|[\s'\"(\[‘’“”])(?:{'|'.join(NEGATORS)})[.,;:]?\s*$", re.I)
_OWN = re.compile(rf"\s*(?:{'|'.join(NEGATORS)})\s", re.I)
_ELISION = re.compile(r"\[…\]|\(…\)|\[\.\.\.\]|\(\.\.\.\)|…|\.\.\.")
_ALTERED = re.compile(r"\[([A-Za-z][A-Za-z']*)\]")


def _loose(quote: str) -> str:
    """A pattern of a quote's words: any white space between them, alike characters, soft hyphens anywhere."""
    words = quote.replace(SOFT, "").split()
    return rf"(?:\s|{SOFT})+".join(f"{SOFT}*".join(_CLASS.get(c) or re.escape(c) for c in w) for w in words)


def _pieces(quote: str) -> list[str]:
    return [p for p in (" ".join(x.split()) for x in _ELISION.split(quote)) if len(p) >= 4]


def _elided(quote: str) -> str | None:
    """A pattern of a quote's pieces of four characters or more, in order, with gaps in proportion to what follows; None under two pieces."""
    pieces = _pieces(quote)
    if len(pieces) < 2:
        return None
    return _loose(pieces[0]) + "".join(rf"(?:\s+|\S){{0,{400 + 5 * len(p)}}}?{_loose(p)}" for p in pieces[1:])


def _rare(quote: str) -> str:
    """The longest run of plain letters in a quote, in lower case: a text without it has no need of patterns."""
    return max(re.findall(r"[a-z]+", _ALTERED.sub(" ", _ELISION.sub(" ", quote)).lower()), key=len, default="")


#: What case-insensitive patterns take for ASCII letters, though they are none.
_LETTER_LIKE = re.compile("[\u0130\u0131\u017f\u212a]")
_KEPT = bytes(range(256)).lower()
_PASSED_OVER = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)


def _letters(text: str) -> bytes:
    """The ASCII letters and digits of a text, in lower case: what each form of a quote leaves as it is, in order."""
    return text.encode("ascii", "ignore").translate(_KEPT, _PASSED_OVER)


@lru_cache(maxsize=512)
def _pattern(how: str, quote: str) -> re.Pattern:
    return re.compile({"exact": re.escape, "canonical": _loose, "elision": _elided}[how](quote), 0 if how == "exact" else re.I)


@lru_cache(maxsize=512)
def _rungs(quote: str) -> tuple[str, tuple[tuple[str, str, str, tuple[bytes, ...]], ...]]:
    """The rare run of a quote, and its forms: (how, pattern's kind, what it is of, letters that a text with it has). Patterns are made where these are there."""
    bare = _ALTERED.sub(r"\1", quote)
    forms = [("exact", "exact", quote, (_letters(quote),))]
    if _loose(quote):
        forms.append(("canonical", "canonical", quote, (_letters(quote),)))
    if bare != quote:
        forms.append(("brackets", "canonical", bare, (_letters(bare),)))
    if _elided(bare):
        forms.append(("elision", "elision", bare, tuple(_letters(x) for x in _pieces(bare))))
    return _rare(quote), tuple(forms)


def find_quote(text: str | None, quote: str | None) -> tuple[str, int, int] | None:
    """How (exact, canonical, brackets, elision) and where ``text`` has ``quote``; words are never changed.

    Each form of the quote is one pattern over the text itself, compiled only if the text has the form's letters in a row. Its first occurrence
    counts that doesn't leave out a negator of the text right before it.
    """
    if not text or not quote or not quote.strip():
        return None
    rare, rungs = _rungs(quote)
    if rare and SOFT not in text and rare not in text.lower():
        return None
    own = _OWN.match(quote)
    letters = None if _LETTER_LIKE.search(text) or _LETTER_LIKE.search(quote) else _letters(text)
    for how, kind, of, needed in rungs:
        if letters is not None and not all(x in letters for x in needed):
            continue
        if kind == "exact" and of not in text:
            continue
        pattern = _pattern(kind, of)
        m = pattern.search(text)
        while m:
            if own or not _LEFT_OUT.search(text[max(0, m.start() - 48) : m.start()].replace(SOFT, "")):
                return how, m.start(), m.end()
            m = pattern.search(text, m.start() + 1)
    return None


#: What patterns take for another character whatever the case, beside what folds to one.
_SAME = [(c, group[0]) for group in ALIKE for c in group[1:]] + [(SOFT, ""), ("\u0130", "i"), ("\u0131", "i")]


def spelled(text: str) -> str:
    """A text as patterns of quotes compare it: no white space and soft hyphens, one for all that are alike, cases folded.

    Each character by itself, so that a text that has a quote in any form has the spelled
    parts of it side by side.
    """
    text = _BLANK.sub("", text)
    if not text.isascii():
        for old, new in _SAME:
            text = text.replace(old, new)
    return text.casefold()


def essential(quote: str) -> str:
    """The longest spelled part of a quote that every text has in which ``find_quote`` finds it, whatever the form."""
    parts = [quote]
    if len(_pieces(_ALTERED.sub(r"\1", quote))) > 1:
        parts = [p for p in _ELISION.split(quote) if len(" ".join(_ALTERED.sub(r"\1", p).split())) >= 4]
    return max((spelled(x) for p in parts for x in _ALTERED.split(p)), key=len, default="")


# -------------------------------------------------------------------- passages


def passage(text: str | None, tokens: list[str], length: int = 600, most_hits: int | None = None) -> dict:
    """The earliest window of ``length`` characters with most token occurrences, begun a quarter before them.

    ``most_hits``: occurrences of a token that count, the first ones; all if it isn't given.
    """
    flat = _BLANK.sub(" ", text or "")
    low = flat.lower()
    found = array("q")
    for t in tokens:
        at, n = low.find(t), 0
        while at >= 0 and (most_hits is None or n < most_hits):
            found.append(at)
            n += 1
            at = low.find(t, at + max(len(t), 1))
    best, most = -1, 0
    if found:
        hits = np.sort(np.frombuffer(found, np.int64))
        n = np.searchsorted(hits, hits + (length - 1), "right") - np.arange(len(hits))
        best, most = int(hits[n.argmax()]), int(n.max())
    start = max(0, best - length // 4) if best >= 0 else 0
    cut = flat[start : start + length]
    body = cut.strip()
    start += len(cut) - len(cut.lstrip())
    return {"passage": body, "start": start, "end": start + len(body), "hits": most}


# --------------------------------------------------------------------- stemming


def _measure(stem: str) -> int:
    n, vowel = 0, False
    for i, c in enumerate(stem):
        before, vowel = vowel, c in "aeiou" or (c == "y" and i > 0 and not vowel)
        n += before and not vowel
    return n


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 of Porter's 1980 paper (fixed values).
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
#: (suffix, what replaces it) of steps 2 and 3, and suffixes of step 4, longest first; the suffixes of each, for one test of all.
_REPLACED = [sorted((tuple(p.split(":")) for p in rules.split()), key=lambda p: -len(p[0])) for rules in (STEP2, STEP3)]
_SUFFIXES = [tuple(old for old, _ in rules) for rules in _REPLACED]
_DROPPED4 = tuple(sorted(STEP4.split(), key=len, reverse=True))


def stem(word: str) -> str:
    """Porter's stemmer of 1980."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, suffixes in zip(_REPLACED, _SUFFIXES, strict=True):
        for old, new in rules if w.endswith(suffixes) else ():
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in _DROPPED4 if w.endswith(_DROPPED4) else ():
        if w.endswith(old):
            rest = w[: -len(old)]
            if _measure(rest) > 1 and (old != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


stem_once = lru_cache(maxsize=1 << 17)(stem)


# ------------------------------------------------------------- column functions


#: Rows that a task holds as objects at once.
ROWS_AT_ONCE = 256


def _rows(result: str, names: list[str], f: Callable[..., tuple], *columns: Column) -> Column:
    """A struct for each row from a function of one value or two. A batch passes in pieces, so that the objects of a few rows are held, not of a batch."""
    kind = to_arrow_type(StructType.fromDDL(result))

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            arrays = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(arrays[0]), ROWS_AT_ONCE):
                some = zip(*(a.slice(at, ROWS_AT_ONCE).to_pylist() for a in arrays), strict=True)
                yield pa.array([dict(zip(names, f(*v), strict=True)) for v in some], kind)

    given = pa.Array if len(columns) == 1 else tuple[(pa.Array,) * len(columns)]
    run.__annotations__ = {"batches": Iterator[given], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, result)(*columns)


def _values(result: str, f: Callable, column: Column) -> Column:
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([f(None if isinstance(v, float) else v) for v in series], dtype=object)

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, result)(column)


def statute_citations_of(text: Column) -> Column:
    return _values("array<struct<source: string, title: string, section: string, start: int, end: int>>", statute_citations, text)


def or_error(f: Callable[[str | None], object]) -> Callable[[str | None], tuple]:
    """``f`` as a function of one value to (value, error): one bad value never ends a job."""

    def run(value: str | None) -> tuple:
        try:
            return f(value), None
        except Exception as error:  # whatever a value brings up belongs to its row
            return None, f"{type(error).__name__}: {error}"

    return run


def citations_of(text: Column) -> Column:
    """Struct (found, error) of each text."""
    one = "array<struct<kind: string, volume: string, reporter: string, page: string, pin: string, names: array<string>, start: int, end: int>>"
    return _rows(f"found {one}, error string", ["found", "error"], or_error(citations), text)


def unquoted_of(text: Column) -> Column:
    return _values("string", unquoted, text)


def quoted_spans_of(text: Column) -> Column:
    return _values("array<struct<quote: string, start: int, end: int>>", quoted_spans, text)


def stem_of(word: Column) -> Column:
    return _values("string", stem, word)


def clean_markup_of(markup: Column, link: str = OPINION_LINK, whole: bool = False) -> Column:
    """Struct (text, links)."""
    return _rows("text string, links array<struct<target: string, start: int, end: int>>", ["text", "links"], lambda m: clean_markup(m, link, whole), markup)


def find_quote_of(text: Column, quote: Column) -> Column:
    """Struct (how, start, end); null members where the quote isn't found."""
    return _rows("how string, start int, end int", ["how", "start", "end"], lambda t, q: find_quote(t, q) or (None, None, None), text, quote)


def passage_of(text: Column, tokens: Column, most_hits: int | None = None) -> Column:
    names = ["passage", "start", "end", "hits"]

    def one(text: str | None, tokens: list[str]) -> tuple:
        found = passage(text, list(tokens), most_hits=most_hits)
        return tuple(found[n] for n in names)

    return _rows("passage string, start int, end int, hits int", names, one, text, tokens)
