"""Porter's 1980 suffix stripper, from the paper's rule tables, with its author's two later departures (bli, logi).

Case is kept (an upper-case letter counts as a consonant), blanks are removed, words of one or two letters stay.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rule tables of the paper, longest suffix first where one ends another.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as a string of c and v."""
    out = []
    for i, ch in enumerate(word):
        if ch in "aeiou":
            out.append("v")
        elif ch == "y":
            out.append("v" if i and out[-1] == "c" else "c")
        else:
            out.append("c")
    return "".join(out)


def _measure(part: str) -> int:
    return _shape(part).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    table = dict(rules)
    suffix = _longest(word, table)
    if suffix is not None and _measure(head := word[: -len(suffix)]) > 0:
        return head + table[suffix]
    return word


def _plural(w: str) -> str:
    if w.endswith("s"):
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
    if cut is None or "v" not in _shape(cut):
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _double(cut):
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut


def _strip4(w: str) -> str:
    suffix = _longest(w, STEP4)
    if suffix is None:
        return w
    head = w[: -len(suffix)]
    if suffix == "ion" and not head.endswith(("s", "t")):
        return w
    return head if _measure(head) > 1 else w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.replace(" ", "")
    if len(w) <= 2:
        return w
    w = _plural(w)
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        w = _replace(w, rules)
    return _tidy(_strip4(w))


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_array(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: [stem(x) for x in a], na_action="ignore")
