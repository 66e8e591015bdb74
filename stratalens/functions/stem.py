"""Porter's suffix stripping (1980) as column expressions, for the second METEOR stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The suffix tables of the paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]

# Groups of consonants and of vowels; y is a vowel after a consonant, so it opens no first group of vowels.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
VOWEL = f"^(?:{_CONSONANTS}[aeiouy]|[aeiou])"  # a vowel anywhere
_ONCE = f"{VOWEL}[aeiou]*{_CONSONANTS}"
MEASURE_ABOVE_0 = _ONCE
MEASURE_ABOVE_1 = f"{_ONCE}{_VOWELS}{_CONSONANTS}"
MEASURE_1 = f"{_ONCE}(?:{_VOWELS})?$"
SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"  # measure 1, ending in consonant, vowel, consonant
#: A final yy whose last y is a consonant.
DOUBLE_Y = "(?:(?:^|[aeiou])y|[^aeiouy])(?:yy)+$"


def _without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _first_match(word: Column, suffixes: Sequence[str], result: Callable[[str], Column]) -> Column:
    """``result(suffix)`` of the longest suffix that the word ends in, else the word."""
    first, *others = [(word.endswith(suffix), result(suffix)) for suffix in sorted(suffixes, key=len, reverse=True)]
    chosen = F.when(*first)
    for case in others:
        chosen = chosen.when(*case)
    return chosen.otherwise(word)


def _plurals(word: Column) -> Column:
    ends = F.when(word.endswith("sses") | word.endswith("ies"), _without(word, "es"))
    return ends.when(word.endswith("s") & ~word.endswith("ss"), _without(word, "s")).otherwise(word)


def _past(word: Column) -> Column:
    def mended(suffix: str) -> Column:
        stem = _without(word, suffix)
        last = F.substring(stem, -1, 1)
        double = (last == F.substring(stem, -2, 1)) & ~last.isin(*"aeiouy") & (F.length(stem) > 1)
        longer = stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz") | stem.rlike(SHORT)
        shorter = (double & ~last.isin(*"lsz")) | stem.rlike(DOUBLE_Y)
        whole = F.when(longer, F.concat(stem, F.lit("e"))).when(shorter, _without(stem, ".")).otherwise(stem)
        return F.when(stem.rlike(VOWEL), whole).otherwise(word)

    eed = F.when(_without(word, "eed").rlike(MEASURE_ABOVE_0), _without(word, "d")).otherwise(word)
    return F.when(word.endswith("eed"), eed).otherwise(_first_match(word, ("ed", "ing"), mended))


def _final_y(word: Column) -> Column:
    stem = _without(word, "y")
    return F.when(word.endswith("y") & stem.rlike(VOWEL), F.concat(stem, F.lit("i"))).otherwise(word)


def _replaced(word: Column, table: dict[str, str]) -> Column:
    def result(suffix: str) -> Column:
        stem = _without(word, suffix)
        return F.when(stem.rlike(MEASURE_ABOVE_0), F.concat(stem, F.lit(table[suffix]))).otherwise(word)

    return _first_match(word, list(table), result)


def _derived(word: Column) -> Column:
    def result(suffix: str) -> Column:
        stem = _without(word, suffix)
        allowed = stem.rlike(MEASURE_ABOVE_1)
        if suffix == "ion":
            allowed &= stem.endswith("s") | stem.endswith("t")
        return F.when(allowed, stem).otherwise(word)

    return _first_match(word, STEP_4, result)


def _final_e(word: Column) -> Column:
    stem = _without(word, "e")
    drop = stem.rlike(MEASURE_ABOVE_1) | (stem.rlike(MEASURE_1) & ~stem.rlike(SHORT))
    return F.when(word.endswith("e") & drop, stem).otherwise(word)


def _final_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(MEASURE_ABOVE_1), _without(word, "l")).otherwise(word)


#: The steps in their order; each takes the word that the one before left.
STEPS = (
    _plurals, _past, _final_y, lambda word: _replaced(word, STEP_2), lambda word: _replaced(word, STEP_3), _derived, _final_e, _final_l,
)


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with the stem of each; words of one or two letters are their own stem. One row per distinct word is enough."""
    found = words.withColumn(stem, F.col(word))
    for step in STEPS:
        found = found.withColumn(stem, step(F.col(stem)))
    return found.withColumn(stem, F.when(F.length(word) > 2, F.col(stem)).otherwise(F.col(word)))
