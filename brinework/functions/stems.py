"""English stems by Porter's rules (1980), word by word."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of Porter's steps 2, 3 and 4, and what they become.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")


def _shape(part: str) -> str:
    """Its letters as v and c; a y after a consonant is a vowel."""
    out = ""
    for letter in part:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def _measure(part: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(part)))


def _double(part: str) -> bool:
    return len(part) > 1 and part[-1] == part[-2] and _shape(part)[-1] == "c"


def _short(part: str) -> bool:
    """Ends in consonant, vowel, consonant, the last no w, x or y."""
    return _shape(part)[-3:] == "cvc" and part[-1] not in "wxy"


def _changed(word: str, endings: dict[str, str], least: int) -> str:
    """``word`` with the longest of the endings that it has, changed where what is before it has the measure."""
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            part = word[: -len(end)]
            return part + endings[end] if _measure(part) >= least and (end != "ion" or part[-1:] in ("s", "t")) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of under three letters, and what is not of the letters a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        part = next((word[: -len(end)] for end in ("ed", "ing") if word.endswith(end)), "")
        if "v" in _shape(part):
            if part.endswith(("at", "bl", "iz")) or _measure(part) == 1 and _short(part):
                word = part + "e"
            else:
                word = part[:-1] if _double(part) and part[-1] not in "lsz" else part
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _changed(_changed(_changed(word, SECOND, 1), THIRD, 1), FOURTH, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stemmed(text: Column | str) -> Column:
    """A text, its words parted by single spaces, as the stems of its words."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(map(stem, t.split(" "))), na_action="ignore")

    return of(text)
