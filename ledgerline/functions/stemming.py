"""English stems for search, by the published Snowball English (Porter 2) rules.

A word has two regions: the first begins after the first consonant that follows a
vowel, the second is the same within the first. Suffixes are replaced in steps, the
longest that fits counts, and each needs its region. Words are stemmed once in
Arrow for each distinct word of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words without weight in English full-text search
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than "
    "too very s t can will just don should now"
).split()
# fixed values: words whose stems are told, and words that stay after the plural is gone
_TOLD = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
_STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# fixed values: beginnings after which the first region begins
_BEGINNINGS = ("gener", "commun", "arsen")
# fixed values: suffixes of the second, third and fourth step
_SECOND = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al",
    aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful",
    lessli="less", li="",
)
_THIRD = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, begin: int) -> int:
    found = _REGION.search(word, begin)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    first = next((len(b) for b in _BEGINNINGS if word.startswith(b)), None)
    first = _after(word, 0) if first is None else first
    return first, _after(word, first)


def _longest(word: str, suffixes: tuple[str, ...] | list[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    found = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if found == "sses":
        return w[:-2]
    if found in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if found == "s" and _VOWEL.search(w[:-2]) else w


def _past(w: str, first: int) -> str:
    found = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found is None:
        return w
    rest = w[: -len(found)]
    if found.startswith("eed"):
        return rest + "ee" if len(rest) >= first else w
    if not _VOWEL.search(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLES):
        return rest[:-1]
    # a short word ends in a short syllable and has no first region
    return rest + "e" if first >= len(rest) and _SHORT_END.search(rest) else rest


def _replaced(w: str, table: dict[str, str], region: int, allowed: Callable[[str, str], bool]) -> str:
    found = _longest(w, list(table))
    if found is None or len(w) - len(found) < region or not allowed(found, w[: -len(found)]):
        return w
    return w[: -len(found)] + table[found]


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in _TOLD:
        return _TOLD[word]
    if len(word) < 3:
        return word
    w = word.removeprefix("'")
    # a y that sounds as a consonant is no vowel
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + w[1:] if w.startswith("y") else w)
    first, second = _regions(w)
    w = w[: -len(s)] if (s := _longest(w, ("'", "'s", "'s'"))) else w
    w = _plural(w)
    if w in _STAY:
        return w
    w = _past(w, first)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    w = _replaced(w, _SECOND, first, lambda s, rest: rest.endswith("l") if s == "ogi" else rest[-1:] in tuple("cdeghkmnrt") if s == "li" else True)
    w = _replaced(w, _THIRD, first, lambda s, rest: s != "ative" or len(rest) >= second)
    w = _replaced(w, dict.fromkeys(_FOURTH, ""), second, lambda s, rest: s != "ion" or rest.endswith(("s", "t")))
    if w.endswith("e") and (len(w) > second or (len(w) > first and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.lower()


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])


def stems(words: str | Column) -> Column:
    """An array of words as stems."""
    return F.pandas_udf(_stems, T.ArrayType(T.StringType()))(words)
