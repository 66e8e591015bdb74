"""Text rules shared by prompts, answers and captions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

# Every code point that Python's str.strip removes.
BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Token separators for captions, any language or English only.
UNICODE_SEPARATORS = r"[^\p{L}\p{N}]+"
ENGLISH_SEPARATORS = r"[^a-z0-9]+"


def strip(text: Column) -> Column:
    """Remove blanks of any script from both ends."""
    return F.trim(text, F.lit(BLANKS))


def token_text(text: Column, separators: str = UNICODE_SEPARATORS) -> Column:
    """Lower-case tokens joined by single spaces; empty when there are none, or no text."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), separators, " ")), F.lit(""))


def tokens(text: Column, separators: str = UNICODE_SEPARATORS) -> Column:
    return F.filter(F.split(F.lower(text), separators), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


# What Python escapes in a printed string, besides quotes and backslashes; and stretches of a text that hold either
# one such character or none.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
STRETCHES = UNPRINTABLE + r"|[ [\P{C}&&\P{Z}]]+"


def _escaped(char: Column) -> Column:
    digits = F.lower(F.hex(F.ascii(char)))
    return (
        F.when(F.length(digits) <= 2, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(F.length(digits) <= 4, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def _with_marks(item: Column) -> Column:
    """The characters that have an escape of their own, in whole passes over the text."""
    for char, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        item = F.replace(item, F.lit(char), F.lit(shown))
    return item


def _with_codes(body: Column) -> Column:
    """Other unprintable characters by their code; what stands between them stays in one piece."""
    stretches = F.regexp_extract_all(body, F.lit(STRETCHES), F.lit(0))
    shown = F.transform(stretches, lambda s: F.when(s.rlike(f"^{UNPRINTABLE}"), _escaped(s)).otherwise(s))
    return F.when(body.rlike(UNPRINTABLE), F.array_join(shown, "")).otherwise(body)


def _in_quotes(body: Column) -> Column:
    single, double = F.contains(body, F.lit("'")), F.contains(body, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def list_notation(items: Column) -> Column:
    """An array of strings printed the way Python prints a list."""
    for step in (_with_marks, _with_codes, _in_quotes):  # each is a pass of its own, so no text is made twice
        items = F.transform(items, step)
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def first_sentence(generated: Column) -> Column:
    """Text up to the first line end or sentence mark."""
    return F.regexp_extract(generated, r"^\s*([^\n.!?]*[.!?]?)", 1)


def clean_generated(generated: Column) -> Column:
    return strip(generated)


# Headings that open an article-style suffix in base-model captions.
SUFFIX_HEADINGS = ["Keywords", "Tags", "Title", "Description", "Categories", "Question", "Answer"]


def has_suffix(generated: Column) -> Column:
    """A line after the first opens with a heading or is a question."""
    heading = r"\n\s*(?:" + "|".join(h.lower() for h in SUFFIX_HEADINGS) + r")\b|\n[^\n]*\?"
    return F.lower(generated).rlike(heading)


def line_repetition(generated: Column) -> Column:
    """Non-blank lines over distinct non-blank lines."""
    lines = F.filter(F.transform(F.split(generated, "\n"), strip), lambda line: line != "")
    return F.size(lines) / F.nullif(F.size(F.array_distinct(lines)), F.lit(0))


def token_repetition(generated: Column, separators: str = UNICODE_SEPARATORS) -> Column:
    """Tokens over distinct tokens: 1 when nothing repeats, NULL for no tokens."""
    found = tokens(generated, separators)
    return F.size(found) / F.nullif(F.size(F.array_distinct(found)), F.lit(0))
