"""Prompt builders for evaluation items, instructions and image captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.text import list_notation, strip

# Prompt wording and image placeholder.
CHOICE_HEADER = "Choose the correct answer from the options below."
IMAGE_TOKEN = "<|image|>"


def mmlu_prompt(question: Column, choices: Column, header: bool = True) -> Column:
    options = F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c))
    lines = [F.concat(F.lit("Question: "), question), F.array_join(options, "\n"), F.lit("Answer:")]
    if header:
        lines.insert(0, F.lit(CHOICE_HEADER))
    return F.concat_ws("\n", *lines)


def hellaswag_prompt(ctx: Column, endings: Column) -> Column:
    return F.concat(F.lit("Sentence: "), ctx, F.lit("\nOptions: "), list_notation(endings), F.lit("\nAnswer:"))


def truthfulqa_prompt(question: Column, mc1_targets: Column) -> Column:
    options = F.transform(
        mc1_targets["choices"], lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)
    )
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.array_join(options, "\n"), F.lit("Answer:"))


PROMPTS = {
    "mmlu": lambda: mmlu_prompt(F.col("question"), F.col("choices")),
    "hellaswag": lambda: hellaswag_prompt(F.col("ctx"), F.col("endings")),
    "truthfulqa": lambda: truthfulqa_prompt(F.col("question"), F.col("mc1_targets")),
}


def format_items(items: DataFrame, benchmark: str) -> DataFrame:
    """Add ``prompt`` in the wording of the named benchmark."""
    return items.withColumn("prompt", PROMPTS[benchmark]())


def instruction_prompt(instruction: Column, context: Column) -> Column:
    """Instruction, the context line unless it is blank, and the answer cue."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Instruction: "), instruction),
        F.when(strip(context) != "", F.concat(F.lit("Context: "), context)),
        F.lit("Answer:"),
    )


def format_instructions(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only ``prompt`` and ``completion`` remain, besides the columns to ``keep``."""
    return records.select(
        *keep,
        instruction_prompt(F.col("instruction"), F.col("context")).alias("prompt"),
        F.col("response").alias("completion"),
    )


def chat_messages(prompt: Column) -> Column:
    """One user turn: an image part and a text part."""
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(image, text).alias("content")))


def plain_image_prompt(prompt: Column, image_token: str = IMAGE_TOKEN) -> Column:
    """Prompt for a model without a chat template."""
    return F.concat_ws("\n", F.lit(image_token), prompt)
