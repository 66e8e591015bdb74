"""Analysis inputs derived from the driver's tables (one function per view)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.functions.text import tokens
from stratalens.operators.rows import enumerate_rows
from stratalens.operators.tokens import word_ids
from stratalens.session import spread

N_LAYERS = 24
MODEL = "m24"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 consecutive vectors are the layer states of one sample; layer 0 is the embedding output."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("sample_id"),
        (F.col("vec_id") % 25).cast("int").alias("layer"),
        F.col("embedding").alias("v"),
    )


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 consecutive vectors: 4 layers of 5 positions, with a right-padding mask."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 20).alias("sample_id"),
        (F.floor(vec / 5) % 4).cast("int").alias("layer"),
        (vec % 5).cast("int").alias("pos"),
        (vec % 5 <= F.floor(vec / 20) % 5).cast("int").alias("mask"),
        F.col("embedding").alias("v"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order: the options are the parts of all its lines, by line number, part and price."""
    options = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice")))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(options.alias("options"))
    prices = F.transform("options", lambda o: o["l_extendedprice"])
    return (
        table(spark, sf_dir, "orders")
        .join(listed, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("item_id"),
            F.concat(
                F.lit("Which part of order "), F.col("o_orderkey").cast("string"), F.lit(" costs most?")
            ).alias("question"),
            F.transform("options", lambda o: o["l_partkey"].cast("string")).alias("choices"),
            (F.array_position(prices, F.array_max(prices)) - 1).cast("int").alias("answer"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per event, in the shapes an answer parser meets."""
    event = F.col("event_id")

    def letter(number, options):
        return F.char(F.lit(65) + number % options)

    answer = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Answer: "), letter(event, 4)))
        .when(F.col("event_type") == "click", "Answer:")
        .when(F.col("event_type") == "signup", "no answer here")
        .when(F.col("event_type") == "error", F.concat(F.lit("Note: "), letter(F.col("user_id"), 4), F.lit(": later")))
        .otherwise(F.concat(F.lit("Answer:   "), letter(event, 3), F.lit(" and more  ")))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        event.alias("item_id"),
        F.concat(F.lit("Question "), event.cast("string"), F.lit("\n"), answer).alias("response"),
        (F.col("user_id") % 4).cast("int").alias("truth"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction and two references per document, all from its whole text.

    The prediction has the lines in reverse order; the references are the text
    as it is, and in lower case without its first two words.
    """
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("sample_id"),
        F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("generated"),
        F.array(
            F.col("text"), F.regexp_replace(F.lower("text"), r"^\s*\S+\s+\S+\s*", "")
        ).alias("refs"),
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn; the system messages, in order, are the context."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answered = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    told = F.array_sort(F.collect_list(F.struct("turn", "text")))
    system = talk.where("role = 'system' AND text IS NOT NULL").groupBy("conv_id").agg(told.alias("told"))
    system = system.select("conv_id", F.array_join(F.transform("told", lambda t: t["text"]), "\n").alias("context"))
    return (
        asked.join(system, "conv_id", "left")
        .join(answered, ["conv_id", "turn"])
        .select("conv_id", "turn", "instruction", F.coalesce("context", F.lit("")).alias("context"), "response")
    )


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every answered user turn: the assistant's answer as a caption, and the turn before it as its reference."""
    talk = table(spark, sf_dir, "conversations")
    key = F.struct("conv_id", "turn").alias("sample_id")
    made = talk.where("role = 'assistant'").select(key, F.col("text").alias("generated"))
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return made, asked.select(key, F.array("text").alias("refs"))


def alike_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synonym table: words of the conversations that begin with the same five letters share a synset."""
    word = F.explode(tokens(F.col("text"))).alias("word")
    found = table(spark, sf_dir, "conversations").select(word).distinct()
    return found.withColumn("synset", F.left("word", F.lit(5)))


def turn_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the assistant's turns: one repeats the turn, one stops half way; the reference lacks two words."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    runs = F.array(
        F.struct(F.lit("base").alias("run_id"), F.col("text").alias("generated")),
        F.struct(F.lit("pruned").alias("run_id"), half.alias("generated")),
    )
    refs = F.array(F.regexp_replace("text", r"^\s*\S+\s+\S+\s*", ""))
    made = said.select(F.struct("conv_id", "turn").alias("sample_id"), F.explode(runs).alias("r"), refs.alias("refs"))
    return made.select("sample_id", "r.*", "refs")


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("sample_id"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("latency_ms"),
    )


def energy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("project_name"),
        F.col("event_type").alias("run_id"),
        "event_id",
        F.col("ts").alias("timestamp"),
        (value * 0.37).alias("cpu_energy"),
        (value * 0.54).alias("gpu_energy"),
        (value * 0.09).alias("ram_energy"),
        value.alias("energy_consumed"),
        (value * 0.43).alias("emissions"),
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses per event type; every 17th event has none (NaN)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.lit(1).alias("epoch"),
        "ts",
        "event_id",
        F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"),
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses numbered in time order, from 1 in every run."""
    numbered = enumerate_rows(losses(spark, sf_dir), ["ts", "event_id"], within=["run_id"], name="batch_idx")
    return numbered.select("run_id", "epoch", (F.col("batch_idx") + 1).alias("batch_idx"), "loss")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bodies as image bytes; every 7th fetch failed."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("payload")
    )


def token_ids(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Documents as word ids, whole or their ``first`` words; the vocabulary is that of the whole texts."""
    wanted = {"input_ids": lambda w: w if first is None else F.slice(w, 1, first)}
    return word_ids(texts(spark, sf_dir), "doc_id", F.lower("text"), wanted)


def prompt_completion_ids(spark: SparkSession, sf_dir: str, max_len: int) -> DataFrame:
    """The first half of a document's words is the prompt, the rest the completion; ids of ``max_len`` words of each."""

    def half(w):
        return F.floor(F.size(w) / 2).cast("int")

    sides = {
        "prompt_ids": lambda w: F.slice(w, F.lit(1), F.least(half(w), F.lit(max_len))),
        "completion_ids": lambda w: F.slice(w, half(w) + 1, F.least(F.size(w) - half(w), F.lit(max_len))),
    }
    return word_ids(texts(spark, sf_dir), "doc_id", F.lower("text"), sides)
