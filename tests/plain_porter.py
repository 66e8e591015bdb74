"""Porter's suffix stripping (1980) word by word, to hold the column expressions against."""

import re

from stratalens.functions.stem import STEP_2, STEP_3, STEP_4


def _shape(word: str) -> str:
    """The word as v (vowel) and c (consonant) marks; y is a vowel after a consonant."""
    marks = ""
    for char in word:
        vowel = char in "aeiou" or (char == "y" and marks.endswith("c"))
        marks += "v" if vowel else "c"
    return marks


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _ends_double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem).endswith("c")


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def _plurals(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _ends_cvc(stem)):
                return stem + "e"
            return stem[:-1] if _ends_double(stem) and stem[-1] not in "lsz" else stem
    return word


def _drop_derived(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = suffix != "ion" or stem.endswith(("s", "t"))
            return stem if allowed and _measure(stem) > 1 else word
    return word


def _final_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 0), STEP_3, 0)
    return _final_letters(_drop_derived(word))
