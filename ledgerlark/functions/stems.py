"""Search terms: words folded to plain letters and cut to their stems by the Porter algorithm (1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")
LONGEST = 64

# fixed values of the published algorithm: suffixes and what they become
STEP_2 = (
    "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,"
    "ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
)
STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP_4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"


def _rules(text: str) -> list[tuple[str, str]]:
    """(suffix, replacement), long suffixes first."""
    pairs = [(rule.split(" ") + [""])[:2] for rule in text.split(",")]
    return sorted(((a, b) for a, b in pairs), key=lambda p: -len(p[0]))


RULES_2, RULES_3, RULES_4 = _rules(STEP_2), _rules(STEP_3), _rules(STEP_4)


def _kinds(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    found = ""
    for letter in word:
        found += "v" if letter in "aeiou" or (letter == "y" and found.endswith("c")) else "c"
    return found


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            fits = _measure(stem) >= least and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem + new if fits else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or very long ones, stay as they are."""
    if not 2 < len(word) <= LONGEST:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    mended = False
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _kinds(word[: -len(suffix)]):
                word, mended = word[: -len(suffix)], True
                break
    if mended:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, RULES_2, 1)
    word = _replaced(word, RULES_3, 1)
    word = _replaced(word, RULES_4, 2)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if _doubled(word) and word.endswith("l") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 17)
def term(word: str) -> str:
    """The term of a word: letters without their marks, stemmed."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return stem(word)


def terms(text: str | None) -> list[str]:
    """The terms of a text in order: lower-case runs of letters and digits, folded and stemmed."""
    return [term(w) for w in WORD.findall((text or "").lower())]


# ---- the same as SQL, for comparing ------------------------------------------------------------------------


def stem_sql(words: str) -> str:
    """DuckDB SQL of a relation (word, term) for a relation with distinct lower-case words ``word``.

    A y that is a consonant is written Y, so that conditions are patterns on the stem; each step is a query over the one before.
    """
    consonant, vowel = "[^aeiouy]", "[aeiouy]"
    measure = lambda n: f"^{consonant}*" + f"{vowel}+{consonant}+" * n
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    cut = lambda n: f"w[:-{n + 1}]"
    double = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxY") + ")$"
    short = f"{consonant}{vowel}[^aeiouywxY]$"
    one = f"(({has('x', measure(1))}) AND NOT ({has('x', measure(2))}))"

    def suffixes(rules: list[tuple[str, str]], least: int) -> str:
        whens = ""
        for suffix, new in rules:
            x = cut(len(suffix))
            ends = f" AND {has(x, '[st]$')}" if suffix == "ion" else ""
            whens += f"WHEN {has('w', suffix + '$')} THEN CASE WHEN {has(x, measure(least))}{ends} THEN {x} || '{new}' ELSE w END "
        return f"CASE {whens}ELSE w END"

    mended = f"""CASE WHEN {has('x', '(at|bl|iz)$')} THEN x || 'e' WHEN {has('x', double)} THEN x[:-2]
        WHEN {one} AND {has('x', short)} THEN x || 'e' ELSE x END"""
    steps = [
        f"CASE WHEN {has('w', '(sses|ies)$')} THEN {cut(2)} WHEN {has('w', 's$')} AND NOT {has('w', 'ss$')} THEN {cut(1)} ELSE w END",
        f"""CASE WHEN {has('w', 'eed$')} THEN CASE WHEN {has(cut(3), measure(1))} THEN {cut(1)} ELSE w END
        WHEN {has('w', 'ed$')} AND {has(cut(2), vowel)} THEN {_within(mended, cut(2))}
        WHEN {has('w', 'ing$')} AND {has(cut(3), vowel)} THEN {_within(mended, cut(3))} ELSE w END""",
        f"CASE WHEN {has('w', '[yY]$')} AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE w END",
        suffixes(RULES_2, 1),
        suffixes(RULES_3, 1),
        suffixes(RULES_4, 2),
        f"""CASE WHEN {has('w', 'e$')} AND ({has(cut(1), measure(2))} OR ({has(cut(1), measure(1))} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE w END""",
        f"CASE WHEN {has('w', 'll$')} AND {has('w', measure(2))} THEN {cut(1)} ELSE w END",
    ]
    plain = "strip_accents(word)"
    marked = f"regexp_replace(regexp_replace({plain}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')"
    query = f"SELECT word, {plain} AS plain, {marked} AS w FROM ({words})"
    for step in steps:
        query = f"SELECT word, plain, {step} AS w FROM ({query})"
    return f"SELECT word, CASE WHEN length(plain) BETWEEN 3 AND {LONGEST} THEN replace(w, 'Y', 'y') ELSE plain END AS term FROM ({query})"


def _within(expression: str, x: str) -> str:
    """``expression`` with its operand ``x`` written out."""
    return re.sub(r"\bx\b", lambda _: x, expression)
