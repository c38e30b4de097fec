"""Porter's stemmer in SQL, by regular expressions over the measure of a stem: what the index's terms are compared with."""

from __future__ import annotations

from ..functions.text import STEP2, STEP3, STEP4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _is(pattern: str, x: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _some(x: str) -> str:  # measure above 0
    return _is(f"^({_C})?{_V}{_C}", x)


def _one(x: str) -> str:
    return _is(f"^({_C})?{_V}{_C}({_V})?$", x)


def _more(x: str) -> str:
    return _is(f"^({_C})?{_V}{_C}{_V}{_C}", x)


def _vowel(x: str) -> str:
    return _is(f"^({_C})?[aeiouy]", x)


def _short(x: str) -> str:  # consonant, vowel, consonant at the end, measure 1
    return _is(f"^{_C}[aeiouy][^aeiouwxyY]$", x)


def _ends(end: str) -> str:
    return f"s LIKE '%{end}'"


def _replaced(pairs: str) -> str:
    rules = sorted((p.split(":") for p in pairs.split()), key=lambda p: -len(p[0]))
    cases = " ".join(f"WHEN {_ends(a)} THEN CASE WHEN {_some(f'left(s, -{len(a)})')} THEN left(s, -{len(a)}) || '{b}' ELSE s END" for a, b in rules)
    return f"CASE {cases} ELSE s END"


def _dropped() -> str:
    cases = []
    for end in sorted(STEP4.split(), key=len, reverse=True):
        rest = f"left(s, -{len(end)})"
        also = f" AND regexp_matches({rest}, '[st]$')" if end == "ion" else ""
        cases.append(f"WHEN {_ends(end)} THEN CASE WHEN {_more(rest)}{also} THEN {rest} ELSE s END")
    return f"CASE {' '.join(cases)} ELSE s END"


_STEPS = (
    f"CASE WHEN {_ends('sses')} OR {_ends('ies')} THEN left(s, -2) WHEN {_ends('s')} AND NOT {_ends('ss')} THEN left(s, -1) ELSE s END",
    f"CASE WHEN {_ends('eed')} THEN CASE WHEN {_some('left(s, -3)')} THEN left(s, -1) ELSE s END WHEN {_ends('ed')} AND {_vowel('left(s, -2)')} THEN left(s, -2) || '#'"
    f" WHEN {_ends('ing')} AND {_vowel('left(s, -3)')} THEN left(s, -3) || '#' ELSE s END",
    f"CASE WHEN NOT {_ends('#')} THEN s WHEN regexp_matches(s, '(at|bl|iz)#$') THEN left(s, -1) || 'e' WHEN s[-2] = s[-3] AND s[-2] NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    f" THEN left(s, -2) WHEN {_short('left(s, -1)')} THEN left(s, -1) || 'e' ELSE left(s, -1) END",
    f"CASE WHEN {_ends('y')} AND {_vowel('left(s, -1)')} THEN left(s, -1) || 'i' ELSE s END",
    _replaced(STEP2),
    _replaced(STEP3),
    _dropped(),
    f"CASE WHEN {_ends('e')} AND ({_more('left(s, -1)')} OR ({_one('left(s, -1)')} AND NOT {_short('left(s, -1)')})) THEN left(s, -1) ELSE s END",
    f"CASE WHEN {_ends('ll')} AND {_more('s')} THEN left(s, -1) ELSE s END",
)

#: Continues a WITH clause that has ``v`` (term): ``stems`` (term, stem). A leading y is a consonant, so it stands as Y meanwhile.
STEMS = (
    ", st0 AS (SELECT term, CASE WHEN starts_with(term, 'y') THEN 'Y' || substr(term, 2) ELSE term END AS s FROM v)"
    + "".join(f", st{k + 1} AS (SELECT term, {step} AS s FROM st{k})" for k, step in enumerate(_STEPS))
    + f", stems AS (SELECT term, CASE WHEN len(term) < 3 THEN term WHEN starts_with(s, 'Y') THEN 'y' || substr(s, 2) ELSE s END AS stem FROM st{len(_STEPS)})"
)
