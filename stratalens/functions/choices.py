"""Reading an answer out of a response, and the right answer out of an item."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratalens.functions.text import strip

UNPARSED = -1  # fixed value: output mark for a response without an answer

# Code of the first option, by the way a benchmark marks its options.
FIRST_OPTION = {"letter": ord("A"), "digit": ord("1")}


def answer_mark(response: Column) -> Column:
    """First character after the first colon of the last line; NULL if there is none."""
    last_line = F.element_at(F.split(strip(response), "\n"), -1)
    answer = strip(F.get(F.split(last_line, ":"), F.lit(1)))
    return F.nullif(F.substring(answer, 1, 1), F.lit(""))


def parse_choice(response: Column, index_base: int = 0, marks: str = "letter") -> Column:
    """Option number counted from ``index_base``; NULL when the response has none.

    ``index_base=1`` with letters gives the 1-based number of the original rule.
    """
    return F.ascii(answer_mark(response)) - F.lit(FIRST_OPTION[marks] - index_base)


def parsed_or_mark(choice: Column) -> Column:
    return F.coalesce(choice, F.lit(UNPARSED))


def first_true_label(labels: Column) -> Column:
    """0-based position of the first label 1; fails when there is none."""
    position = F.array_position(labels, 1).cast("int")
    return F.when(position > 0, position - 1).otherwise(
        F.raise_error(F.lit("no label 1 among the choices")).cast("int")
    )


TRUTHS = {
    "mmlu": lambda: F.col("answer").cast("int"),
    "hellaswag": lambda: F.col("label").cast("int"),
    "truthfulqa": lambda: first_true_label(F.col("mc1_targets.labels")),
}


def ground_truth(benchmark: str) -> Column:
    return TRUTHS[benchmark]()
