"""The registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens import schemas, views
from stratalens.functions import choices, prompts, text
from stratalens.functions.vectors import angular_distance
from stratalens.inference import generate, hidden_states
from stratalens.operators import accuracy, blocks, captions, losses, payloads, rows, runs, telemetry, tokens
from stratalens.plans import pruning
from stratalens.session import shared_path
from stratalens.sources import bodies, reports, tables
from stratalens.sources.states import read_states, write_states
from stratalens.streaming import progress
from stratalens.streaming.latency import drain, windowed_latency

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATASET = "driver"
ALL_N = list(range(1, views.N_LAYERS))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def six(name: str) -> Column:
    return F.round(name, 6).alias(name)


def id_text(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


# --- layer similarity ---------------------------------------------------------------------------


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = blocks.drop_embedding_state(views.hidden_states(spark, sf_dir))
    return blocks.pack_layers(states, views.N_LAYERS)


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_distances(packed(spark, sf_dir))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.best_block(distances(spark, sf_dir)).withColumn("model", F.lit(views.MODEL))


@query
def block_distance_n(spark, sf_dir):
    found = blocks.block_distances(packed(spark, sf_dir), n=3)
    return found.select("n", "block_start", "block_end", six("average_distance"))


@query
def block_distance_all(spark, sf_dir):
    return distances(spark, sf_dir).select("n", "block_start", "block_end", six("average_distance"))


@query
def bucketed_block_distance(spark, sf_dir):
    """From states stored in buckets by sample: no vector is shuffled after the table is written."""
    stored = read_states(spark, write_states(views.hidden_states(spark, sf_dir)))
    layers = blocks.pack_stored_layers(blocks.drop_embedding_state(stored), views.N_LAYERS)
    return blocks.block_distances(layers).select("n", "block_start", "block_end", six("average_distance"))


@query
def best_block(spark, sf_dir):
    return best(spark, sf_dir).select("n", "block_start", "block_end", six("average_distance"))


@query
def min_distance(spark, sf_dir):
    found = blocks.min_distance(distances(spark, sf_dir))
    means = F.array_join(F.transform("mean_distances", lambda d: F.format_string("%.6f", d)), ",")
    return found.select("n", six("min_distance"), "layer_idx", means.alias("mean_distances"))


@query
def distance_matrix(spark, sf_dir):
    matrix = blocks.distance_matrix(distances(spark, sf_dir), ALL_N)
    return matrix.select("layer", *[six(f"n_{n}") for n in ALL_N])


@query
def distance_matrix_end(spark, sf_dir):
    matrix = blocks.distance_matrix(distances(spark, sf_dir), ALL_N, axis="end")
    return matrix.select("layer", *[six(f"n_{n}") for n in ALL_N])


@query
def last_token_state(spark, sf_dir):
    found = blocks.last_token_state(views.token_states(spark, sf_dir))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return found.select("sample_id", "layer", "pos", F.round(size, 6).alias("norm"))


@query
def batch_assign(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return rows.assign_batches(docs, ["doc_id"], 32, full_only=True)


@query
def batch_block_distance(spark, sf_dir):
    samples = views.hidden_states(spark, sf_dir).select("sample_id").distinct()
    batches = rows.assign_batches(samples, ["sample_id"], 4, full_only=True)
    found = blocks.batch_block_distance(packed(spark, sf_dir), batches)
    return found.select("batch_id", "n", "block_start", six("average_distance"))


@query
def shuffled_batches(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    keyed = docs.withColumn("_order", rows.shuffle_key(F.col("doc_id"), seed=7))
    return rows.assign_batches(keyed, ["_order", "doc_id"], 2).drop("_order")


STATE_LETTERS = "aeinrstu"


def letter_states():
    """Stand-in for a model: four layers of letter counts, shifted by layer and position."""

    def states(texts):
        counts = [[text.count(letter) for letter in STATE_LETTERS] for text in texts]
        return [[[c + layer * (j + 1) for j, c in enumerate(row)] for layer in range(4)] for row in counts]

    return states


@query
def model_block_distance(spark, sf_dir):
    found = blocks.block_distances(hidden_states(views.texts(spark, sf_dir), letter_states))
    return found.select("n", "block_start", six("average_distance"))


@query
def pair_layers(spark, sf_dir):
    """Block distances from single pairs of layers, by the column form of the distance."""
    states = blocks.drop_embedding_state(views.hidden_states(spark, sf_dir))
    pairs = blocks.pair_layers(states, 5).withColumn("d", angular_distance(F.col("low_v"), F.col("high_v")))
    return pairs.groupBy((F.col("low_layer") + 1).alias("block_start")).agg(F.round(F.avg("d"), 6).alias("average_distance"))


@query
def report_names(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    ending = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    path = F.concat(F.lit("reports/"), name, ending, F.lit(".csv"))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        reports.file_suffix_number(path).alias("n"),
        reports.report_label(path, "none").alias("label"),
        F.when(F.col("p_size") == 2, reports.report_label(F.lit("a/distances.csv"), "distances")).alias("base_label"),
    )


@query
def report_round_trip(spark, sf_dir):
    """Reports of all block sizes; for as many layers as the model has there is no pair, so no row and no best block."""
    path = shared_path(spark, "reports")
    found = distances(spark, sf_dir).withColumn("dataset", F.lit(DATASET)).withColumn("model", F.lit(views.MODEL))
    sizes = spark.range(1, views.N_LAYERS + 1).select(
        F.lit(DATASET).alias("dataset"), F.lit(views.MODEL).alias("model"), F.col("id").cast("int").alias("n")
    )
    reports.write_distance_reports(found, path, layout="text", sizes=sizes)
    stored, named = reports.read_distance_reports(spark, path)
    named = named.withColumnsRenamed({"block_start": "best_start", "block_end": "best_end"})
    columns = ["dataset", "model", "n", "block_start", "block_end", six("average_distance"), "best_start", "best_end"]
    return sizes.join(stored, reports.KEYS, "left").join(named, reports.KEYS, "left").select(*columns)


# --- pruning plans ------------------------------------------------------------------------------


@query
def prune_keep_layers(spark, sf_dir):
    return pruning.kept_layers(best(spark, sf_dir), views.N_LAYERS, list(pruning.KEEP_RULES)).select("rule", "n", "layer")


@query
def apply_plans(spark, sf_dir):
    """The best blocks against the stored layers of their model."""
    layers = blocks.drop_embedding_state(views.hidden_states(spark, sf_dir)).select(
        F.lit(views.MODEL).alias("model"), "layer"
    )
    kept = pruning.apply_plans(best(spark, sf_dir), layers.distinct(), "left_open")
    return kept.select("model", "n", "layer")


@query
def prune_plan_slices(spark, sf_dir):
    path = shared_path(spark, "plans")
    tables.write_plans(pruning.pruning_plans(best(spark, sf_dir), views.N_LAYERS), path)
    return pruning.slice_rows(tables.read_plans(spark, path))


@query
def performance_curve(spark, sf_dir):
    answered = views.responses(spark, sf_dir).select(
        F.lit(views.MODEL).alias("model"),
        (F.col("item_id") % 25).cast("int").alias("n"),
        choices.parse_choice(F.col("response")).alias("predicted"),
        "truth",
    )
    scored = accuracy.choice_accuracy(answered, ["model", "n"])
    curve = accuracy.performance_curve(best(spark, sf_dir), scored)
    return curve.select("model", "n", "block_start", "block_end", six("accuracy"))


@query
def accuracy_history(spark, sf_dir):
    path = shared_path(spark, "history")
    scored = accuracy.choice_accuracy(
        views.responses(spark, sf_dir).withColumn("predicted", choices.parse_choice(F.col("response"))), ["run_id"]
    )
    tables.append_history(scored.select("run_id", F.lit(1).cast("long").alias("seq"), "accuracy"), path)
    again = tables.read_history(spark, path).withColumn("seq", F.col("seq") + 1)
    tables.append_history(again, path)
    tables.append_history(again.withColumn("accuracy", F.lit(0.0)), path)  # a repeated append counts for nothing
    return tables.read_history(spark, path).select("run_id", "seq", six("accuracy"))


# --- multiple choice ----------------------------------------------------------------------------


@query
def corpus_first_n(spark, sf_dir):
    corpus = tables.read_corpus(spark, f"{sf_dir}/documents.parquet", order="doc_id", first=100)
    return corpus.select("doc_id", "text")


@query
def corpus_first_third(spark, sf_dir):
    """A third of all documents, without a task that holds them; the length of the text makes ties."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return rows.first_n(docs, ["size", "doc_id"], docs.count() // 3, few=100)


@query
def epoch_orders(spark, sf_dir):
    """The order of two epochs over all documents, sorted once: by the identifier."""
    numbered = rows.enumerate_rows(views.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    order = rows.Permutation(numbered.count(), seed=7)
    epochs = [order.with_places(numbered, epoch).withColumn("epoch", F.lit(epoch)) for epoch in (0, 1)]
    return epochs[0].unionByName(epochs[1]).select("doc_id", "epoch", "place", F.floor(F.col("place") / 32).alias("batch_id"))


@query
def items_of_split(spark, sf_dir):
    path = shared_path(spark, "items")
    split = F.when(F.col("answer") == 0, "dev").otherwise("test")
    views.items(spark, sf_dir).withColumn("split", split).write.partitionBy("split").parquet(path)
    return tables.read_items(spark, path, "mmlu").select("item_id", "question", F.size("choices").alias("n_choices"), "answer")


@query
def prompt_mmlu(spark, sf_dir):
    return prompts.format_items(views.items(spark, sf_dir), "mmlu").select("item_id", "prompt")


@query
def prompt_mmlu_plain(spark, sf_dir):
    prompt = prompts.mmlu_prompt(F.col("question"), F.col("choices"), header=False)
    return views.items(spark, sf_dir).select("item_id", prompt.alias("prompt"))


@query
def prompt_hellaswag(spark, sf_dir):
    items = views.items(spark, sf_dir).withColumnsRenamed({"question": "ctx", "choices": "endings"})
    return prompts.format_items(items, "hellaswag").select("item_id", "prompt")


@query
def prompt_hellaswag_texts(spark, sf_dir):
    """Endings with quotes, backslashes and line ends: whole documents, and what stands around their quotes."""
    text = F.col("text")
    marked = F.concat(F.replace(text, F.lit("e"), F.lit("'")), F.lit("\\"), F.replace(F.left(text, F.lit(9)), F.lit("n"), F.lit('"')))
    items = views.texts(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), F.lit("Go on").alias("ctx"), F.array(text, marked, F.lit("it's")).alias("endings")
    )
    return prompts.format_items(items, "hellaswag").select("item_id", "prompt")


@query
def truth_hellaswag(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("label")
    )
    return lines.select("item_id", choices.ground_truth("hellaswag").alias("truth"))


def truthful_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.transform("choices", lambda c, i: (i == F.col("answer")).cast("int"))
    targets = F.struct(F.col("choices"), labels.alias("labels"))
    return views.items(spark, sf_dir).select("item_id", "question", targets.alias("mc1_targets"))


@query
def prompt_truthfulqa(spark, sf_dir):
    return prompts.format_items(truthful_items(spark, sf_dir), "truthfulqa").select("item_id", "prompt")


@query
def truth_truthfulqa(spark, sf_dir):
    return truthful_items(spark, sf_dir).select("item_id", choices.ground_truth("truthfulqa").alias("truth"))


@query
def parse_choice(spark, sf_dir):
    response = F.col("response")
    return views.responses(spark, sf_dir).select(
        "item_id",
        choices.parsed_or_mark(choices.parse_choice(response)).alias("predicted"),
        choices.parsed_or_mark(choices.parse_choice(response, index_base=1)).alias("predicted_from_one"),
        choices.parsed_or_mark(choices.parse_choice(response, marks="digit")).alias("predicted_digit"),
    )


@query
def choice_accuracy(spark, sf_dir):
    predicted = views.responses(spark, sf_dir).select(
        "run_id", "item_id", choices.parse_choice(F.col("response")).alias("predicted")
    )
    items = views.items(spark, sf_dir).withColumn("truth", choices.ground_truth("mmlu"))
    scored = accuracy.choice_accuracy(accuracy.match_predictions(predicted, items), ["run_id"])
    return scored.select("run_id", "correct", "total", six("accuracy"))


def letter_by_length():
    """Stand-in for a model: the answer depends on the length of the prompt."""
    return lambda prompts: ["Answer: " + chr(65 + len(prompt) % 4) for prompt in prompts]


@query
def generate_answers(spark, sf_dir):
    asked = prompts.format_items(views.items(spark, sf_dir), "mmlu")
    answered = generate(asked, letter_by_length).select(
        "item_id", "response", choices.parse_choice(F.col("response")).alias("predicted"), "answer"
    )
    return answered.select("item_id", "response", "predicted", (F.col("predicted") == F.col("answer")).alias("correct"))


@query
def prompt_instruction(spark, sf_dir):
    return prompts.format_instructions(views.instructions(spark, sf_dir), keep=("conv_id", "turn"))


@query
def chat_messages(spark, sf_dir):
    asked = views.instructions(spark, sf_dir)
    messages = asked.select(
        "conv_id",
        "turn",
        F.explode(prompts.chat_messages(F.col("instruction"))).alias("m"),
        prompts.plain_image_prompt(F.col("instruction")).alias("plain"),
    )
    parts = messages.select("conv_id", "turn", "m.role", "plain", F.posexplode("m.content").alias("part", "c"))
    return parts.select("conv_id", "turn", "role", "part", "c.type", "c.text", "plain")


# --- captions -----------------------------------------------------------------------------------


@query
def bleu4(spark, sf_dir):
    score = captions.bleu4(views.captions(spark, sf_dir))
    return score.select(
        *[f"match_{n}" for n in (1, 2, 3, 4)], *[f"total_{n}" for n in (1, 2, 3, 4)], "pred_len", "ref_len", six("bleu4")
    )


@query
def bleu4_matched(spark, sf_dir):
    """Predictions and references from two tables: an assistant's turn against the user's turn before it."""
    made, samples = views.turns(spark, sf_dir)
    score = captions.bleu4(captions.match_references(made, samples), length_rule="shortest")
    return score.select(*[f"match_{n}" for n in (1, 2, 3, 4)], "pred_len", "ref_len", six("bleu4"))


@query
def rouge_l_turns(spark, sf_dir):
    made, asked = views.turns(spark, sf_dir)
    scores = captions.rouge_l_scores(captions.match_references(made, asked))
    return scores.select("sample_id.conv_id", "sample_id.turn", six("rouge_l"))


@query
def meteor_synonym_turns(spark, sf_dir):
    made, asked = views.turns(spark, sf_dir)
    matched = captions.match_references(made, asked)
    scores = captions.meteor_scores(matched, stemming=False, synsets=views.alike_words(spark, sf_dir))
    return scores.select("sample_id.conv_id", "sample_id.turn", six("meteor"))


@query
def meteor_stem_turns(spark, sf_dir):
    """All three stages: equal words, equal stems, words of a synset."""
    made, asked = views.turns(spark, sf_dir)
    matched = captions.match_references(made, asked)
    stems = captions.meteor_scores(matched).withColumnRenamed("meteor", "meteor_stem")
    every = captions.meteor_scores(matched, synsets=views.alike_words(spark, sf_dir))
    return stems.join(every, "sample_id").select("sample_id.conv_id", "sample_id.turn", six("meteor_stem"), six("meteor"))


def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three scores of both runs over the assistant's turns, one row per run and metric."""
    made = views.turn_captions(spark, sf_dir)
    bleu = captions.bleu4(made, keys=("run_id",)).select("run_id", F.lit("bleu4").alias("metric"), F.col("bleu4").alias("value"))
    rouge = captions.mean_score(captions.rouge_l_scores(made), "rouge_l", ("run_id",))
    meteor = captions.mean_score(captions.meteor_scores(made, keys=("run_id", "sample_id")), "meteor", ("run_id",))
    return bleu.unionByName(rouge.select("run_id", F.lit("rougeL").alias("metric"), F.col("rouge_l").alias("value"))).unionByName(
        meteor.select("run_id", F.lit("meteor").alias("metric"), F.col("meteor").alias("value"))
    )


@query
def caption_scores(spark, sf_dir):
    return turn_metrics(spark, sf_dir).select("run_id", "metric", six("value"))


@query
def caption_quality_gate(spark, sf_dir):
    """The run that stops half way against the one that does not."""
    found = turn_metrics(spark, sf_dir)
    passed = runs.quality_gate(found.where("run_id = 'base'"), found.where("run_id = 'pruned'"))
    return passed.select("metric", six("baseline"), six("candidate"), six("ratio"), six("target"), "passed")


@query
def caption_run_record(spark, sf_dir):
    """Both runs as stored records with all twelve rounded numbers; lengths stand for what a machine would measure."""
    path = shared_path(spark, "caption-runs")
    names = [name for names in runs.SECTIONS.values() for name in names]
    scores = turn_metrics(spark, sf_dir).groupBy("run_id").pivot("metric", runs.SECTIONS["quality"]).agg(F.first("value"))
    size = F.length("generated").cast("double")
    sizes = views.turn_captions(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("n_samples"), (F.sum(size) / 7).alias("total_time_s"),
        (F.count("*") * 7 / F.sum(size)).alias("throughput_samples_per_s"), F.avg(size).alias("mean_latency_ms"),
        F.stddev_pop(size).alias("std_latency_ms"), (F.sum(size) / 3e6).alias("energy_kwh"), (F.sum(size) / 7e6).alias("co2_kg"),
        (F.max(size) / 3).alias("peak_vram_mib"), (F.max(size) / 0.7).alias("total_vram_mib"),
    )
    texts = {"model_id": views.MODEL, "dtype": "float32", "dataset": DATASET, "prompt": "Say it again.", "device": "cpu", "gpu_name": "none"}
    flat = scores.join(sizes, "run_id").select(
        "run_id", "n_samples", F.lit(3.14159).alias("n_params_B"), *names, *[F.lit(text).alias(name) for name, text in texts.items()]
    )
    tables.write_run_results(runs.run_results(flat, "scores over turns", "from lengths"), path)
    return runs.flatten_results(tables.read_run_results(spark, path), ["run_id", "model_id", "n_samples", "n_params_B"])


@query
def rouge_l(spark, sf_dir):
    scores = captions.rouge_l_scores(views.captions(spark, sf_dir))
    return captions.mean_score(scores, "rouge_l").select("n_samples", six("rouge_l"))


@query
def meteor_exact(spark, sf_dir):
    scores = captions.meteor_scores(views.captions(spark, sf_dir), stemming=False)
    return scores.select("sample_id", six("meteor"))


@query
def meteor_full(spark, sf_dir):
    scores = captions.meteor_scores(views.captions(spark, sf_dir), stemming=True)
    return captions.mean_score(scores, "meteor").select("n_samples", six("meteor"))


@query
def comparison_rows(spark, sf_dir):
    return shown_captions(spark, sf_dir).select(
        "sample_idx", "coco_id", "generated", F.array_join("refs", "\n---\n").alias("refs"), "n_refs", "img_file"
    )


def shown_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.captions(spark, sf_dir)
    index = rows.enumerate_rows(samples.select("sample_id"), ["sample_id"], name="sample_idx")
    return captions.comparison_rows(samples.join(index, "sample_id").withColumn("coco_id", F.col("sample_id")))


@query
def caption_round_trip(spark, sf_dir):
    path = shared_path(spark, "captions")
    records = shown_captions(spark, sf_dir).select(
        F.lit(views.MODEL).alias("model_id"),
        F.lit("Name what you see.").alias("prompt"),
        "sample_idx",
        "coco_id",
        F.format_string("http://images.example.com/%d.jpg", "coco_id").alias("url"),
        "img_file",
        "generated",
        "refs",
    )
    tables.write_captions(records, path)
    stored = tables.read_captions(spark, path)
    return stored.withColumn("refs", F.array_join("refs", "\n---\n"))


@query
def caption_envelope(spark, sf_dir):
    """Runs of a hundred samples, each stored as one indented object with its samples."""
    path = shared_path(spark, "envelopes")
    shown = shown_captions(spark, sf_dir).withColumn("part", F.floor(F.col("sample_idx") / 100))
    sample = F.struct("sample_idx", "coco_id", "img_file", "generated", "refs")
    run = F.struct(
        F.lit(views.MODEL).alias("model_id"), F.lit("Name what you see.").alias("prompt"),
        F.array_sort(F.collect_list(sample)).alias("samples"),
    )
    texts = shown.groupBy("part").agg(F.to_json(run, {"pretty": "true"}).alias("value"))
    texts.repartition("part").write.partitionBy("part").text(path)
    stored = tables.read_captions(spark, path, layout="envelope")
    return stored.select("model_id", "prompt", "sample_idx", "coco_id", "img_file", "generated", F.array_join("refs", "\n---\n").alias("refs"))


@query
def first_sentence(spark, sf_dir):
    return views.captions(spark, sf_dir).select(
        "sample_id", text.first_sentence(F.col("generated")).alias("first_sentence")
    )


@query
def output_flags(spark, sf_dir):
    generated = F.col("generated")
    return views.captions(spark, sf_dir).select(
        "sample_id",
        text.has_suffix(generated).alias("has_suffix"),
        F.round(text.line_repetition(generated), 6).alias("line_repetition"),
        F.round(text.token_repetition(generated), 6).alias("token_repetition"),
    )


@query
def normalised_refs(spark, sf_dir):
    """Every third document has no list of references, only its caption."""
    listed = F.when(F.col("doc_id") % 3 != 0, F.array(F.col("text"), F.lower("text")))
    refs = captions.normalise_refs(listed, F.col("text"))
    return views.texts(spark, sf_dir).select("doc_id", F.array_join(refs, "\n---\n").alias("refs"))


@query
def payload_files(spark, sf_dir):
    """The addresses of all pages, landed as sixteen files of lines and read as bytes."""
    path = shared_path(spark, "landed")
    lines = views.table(spark, sf_dir, "pages").select((F.col("page_id") % 16).alias("part"), "page_id", F.col("url").alias("value"))
    dealt = lines.repartition("part").sortWithinPartitions("part", "page_id").drop("page_id")
    dealt.write.partitionBy("part").text(path)
    found = tables.read_payloads(spark, path, glob="*.txt")
    return found.select("length", F.md5("payload").alias("digest"))


@query
def payload_bodies(spark, sf_dir):
    """The bodies of all pages, written to a container and read back as bytes."""
    path = shared_path(spark, "bodies")
    bodies.write_bodies(views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("body")), path)
    found = bodies.read_bodies(spark, path, ("key", "length", "body"))
    return found.select(F.col("key").cast("long").alias("page_id"), "length", F.md5("body").alias("digest"))


@query
def payload_lengths(spark, sf_dir):
    """Keys and lengths alone: the bodies of the container are not read. Every third page has no body."""
    path = shared_path(spark, "bodies")
    body = F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("body")
    bodies.write_bodies(views.table(spark, sf_dir, "pages").select(F.col("url").alias("key"), body), path)
    found = bodies.read_bodies(spark, path, ("key", "length"))
    return found.select(F.col("key").alias("url"), "length")


@query
def payload_present(spark, sf_dir):
    pages = views.payloads(spark, sf_dir)
    return payloads.with_payload(pages.select("page_id", "url"), pages.select("url", "payload"))


@query
def payload_missing(spark, sf_dir):
    pages = views.payloads(spark, sf_dir)
    return payloads.without_payload(pages.select("page_id", "url"), pages.select("url", "payload"))


# --- run telemetry ------------------------------------------------------------------------------


@query
def latency_summary(spark, sf_dir):
    found = telemetry.latency_summary(views.inference_log(spark, sf_dir))
    return found.select("run_id", "n_samples", six("mean_latency_ms"), six("std_latency_ms"))


@query
def throughput(spark, sf_dir):
    found = telemetry.throughput(views.inference_log(spark, sf_dir))
    return found.select("run_id", "n_samples", six("total_time_s"), six("samples_per_s"))


@query
def peak_memory(spark, sf_dir):
    log = views.inference_log(spark, sf_dir).withColumnRenamed("latency_ms", "memory_mib")
    return telemetry.peak_memory(log)


def last_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.energy_log(spark, sf_dir)
    return telemetry.last_energy_row(log, order=["timestamp", "event_id"])


@query
def energy_last(spark, sf_dir):
    found = last_energy(spark, sf_dir)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    return found.select("project_name", "event_id", stamp, six("energy_consumed"), six("emissions"))


@query
def energy_share(spark, sf_dir):
    found = telemetry.component_share(last_energy(spark, sf_dir))
    return found.select("project_name", "component", six("energy"), six("share"))


@query
def energy_per_sample(spark, sf_dir):
    log = views.energy_log(spark, sf_dir)
    totals = log.groupBy("project_name").agg(
        F.sum("energy_consumed").alias("energy_consumed"),
        F.sum("emissions").alias("emissions"),
        F.count("*").alias("n_samples"),
    )
    found = telemetry.energy_per_sample(totals)
    return found.select("project_name", "n_samples", six("wh_per_sample"), six("co2_mg_per_sample"))


@query
def energy_totals(spark, sf_dir):
    found = tables.energy_totals(views.energy_log(spark, sf_dir))
    return found.select(six("energy_kwh"), six("co2_kg"))


@query
def energy_log_round_trip(spark, sf_dir):
    path = shared_path(spark, "energy")
    log = views.energy_log(spark, sf_dir)
    fields = [field.strip().split(" ") for field in schemas.ENERGY_LOG.replace("\n", " ").split(",")]
    # Stored in another order than the schema's: the reader goes by name.
    columns = [
        F.col(name) if name in log.columns else F.lit(None).cast(kind).alias(name) for name, kind in reversed(fields)
    ]
    log.select(*columns).write.option("header", True).csv(path)
    stored = tables.read_energy_log(spark, path)
    return stored.groupBy("project_name").agg(
        F.count("*").alias("n_rows"),
        F.round(F.sum("cpu_energy"), 6).alias("cpu_energy"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_at"),
    )


@query
def run_result_record(spark, sf_dir):
    path = shared_path(spark, "runs")
    log = views.inference_log(spark, sf_dir).withColumn("memory_mib", F.col("latency_ms"))
    stamp = runs.run_id(F.min("started_at")).alias("stamp")
    summary = telemetry.run_summary(
        log, stamp, *telemetry.latency_columns(), *telemetry.throughput_columns(), *telemetry.memory_columns()
    )
    energy = telemetry.last_energy_row(views.energy_log(spark, sf_dir), ["timestamp", "event_id"], ["run_id"])
    flat = (
        summary.join(energy.select("run_id", "energy_consumed", "emissions"), "run_id")
        .select(
            F.col("stamp").alias("run_id"),
            F.col("run_id").alias("model_id"),
            F.lit("bfloat16").alias("dtype"),
            F.lit(2.71828).alias("n_params_B"),
            F.lit(DATASET).alias("dataset"),
            "n_samples",
            F.lit("Name what you see.").alias("prompt"),
            *[F.lit(None).cast("double").alias(name) for name in runs.SECTIONS["quality"]],
            "total_time_s",
            F.col("samples_per_s").alias("throughput_samples_per_s"),
            "mean_latency_ms",
            "std_latency_ms",
            F.col("energy_consumed").alias("energy_kwh"),
            F.col("emissions").alias("co2_kg"),
            F.col("peak_memory_mib").alias("peak_vram_mib"),
            F.lit(None).cast("double").alias("total_vram_mib"),
            F.lit("cpu").alias("device"),
            F.lit("N/A").alias("gpu_name"),
        )
    )
    tables.write_run_results(runs.run_results(flat, "not scored", "largest reading of the log"), path)
    return runs.flatten_results(tables.read_run_results(spark, path), ["run_id", "model_id", "n_samples", "n_params_B"])


@query
def quality_gate(spark, sf_dir):
    """Morning events are the baseline run, the others the candidate; one metric per event type."""
    log = views.inference_log(spark, sf_dir)
    half = F.when(F.hour("started_at") < 12, "baseline").otherwise("candidate")
    means = log.groupBy(half.alias("side"), F.col("run_id").alias("metric")).agg(F.avg("latency_ms").alias("value"))
    found = runs.quality_gate(means.where("side = 'baseline'"), means.where("side = 'candidate'"))
    return found.select("metric", six("baseline"), six("candidate"), six("ratio"), six("target"), "passed")


@query
def run_pairs(spark, sf_dir):
    """Every run against the first one by name, for two metrics."""
    log = views.inference_log(spark, sf_dir)
    wide = log.groupBy("run_id").agg(F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("max"))
    values = wide.unpivot(["run_id"], ["mean", "max"], "metric", "value")
    first = wide.agg(F.min("run_id").alias("baseline_run"))
    pairs = wide.select(F.col("run_id").alias("candidate_run")).join(F.broadcast(first))
    found = runs.compare_pairs(values, pairs)
    return found.select("baseline_run", "candidate_run", "metric", six("baseline"), six("candidate"), six("ratio"))


@query
def stream_latency(spark, sf_dir):
    """The events arrive in six files in no order of time, one file per trigger."""
    path, log = shared_path(spark, "arrivals"), views.inference_log(spark, sf_dir).drop("sample_id")
    log.repartition(6, F.col("started_at")).write.parquet(path)
    log = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = drain(windowed_latency(log), ["run_id", "window_start"], "latency")
    return found.select(
        "run_id",
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "n_samples",
        six("mean_latency_ms"),
    )


def streamed_losses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The training log arrives in six files in no order, half of them before the stream is stopped and started again."""
    path, out, state = (shared_path(spark, name) for name in ("losses", "loss-rows", "loss-state"))
    log = views.training_log(spark, sf_dir)
    parts = log.withColumn("part", F.pmod(F.hash("run_id", "batch_idx"), F.lit(6)))
    before = spark.conf.get(progress.STORE)
    spark.conf.set(progress.STORE, progress.ROCKS_DB)
    try:
        for arrived in (F.col("part") < 3, F.col("part") >= 3):
            parts.where(arrived).repartition(3, "part").drop("part").write.mode("append").parquet(path)
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
            found = progress.running_loss_stream(stream, chunk=4096)
            progress.store(found, out, state)
    finally:
        spark.conf.set(progress.STORE, before)
    return progress.settled(spark, out, found.schema)


@query
def stream_running_loss(spark, sf_dir):
    found, _ = streamed_losses(spark, sf_dir)
    return found.select("run_id", "epoch", "batch_idx", (F.round("loss_sum", 4) / F.col("seen")).alias("running_loss"))


@query
def stream_epoch_loss(spark, sf_dir):
    _, found = streamed_losses(spark, sf_dir)
    return found.select("run_id", "epoch", "batches", "valid_batches", six("average_loss"))


# --- training data and logs ---------------------------------------------------------------------


@query
def epoch_loss(spark, sf_dir):
    log = views.losses(spark, sf_dir)
    valid = losses.epoch_loss(log, skip_nan=True).select("run_id", "epoch", F.round("average_loss", 6).alias("valid_loss"))
    return losses.epoch_loss(log).join(valid, ["run_id", "epoch"]).select(
        "run_id", "epoch", "batches", six("average_loss"), "valid_batches", "valid_loss"
    )


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = losses.running_loss(views.training_log(spark, sf_dir))
    # Losses have two decimals, so the rounded sum is exact and the mean does not depend on the order of addition.
    return found.withColumn("running_loss", F.round("loss_sum", 4) / F.col("seen"))


@query
def running_loss(spark, sf_dir):
    return running(spark, sf_dir).select("run_id", "epoch", "batch_idx", "running_loss")


@query
def running_loss_progress(spark, sf_dir):
    found = losses.progress_rows(running(spark, sf_dir))
    return found.select("run_id", "epoch", "batch_idx", "batches", "running_loss")


@query
def token_ids(spark, sf_dir):
    return views.token_ids(spark, sf_dir).select("doc_id", id_text("input_ids"))


@query
def pad_fixed(spark, sf_dir):
    padded = tokens.pad_fixed(views.token_ids(spark, sf_dir, first=128), max_len=128, pad_id=0)
    return padded.select("doc_id", id_text("input_ids"), id_text("attention_mask"))


@query
def train_labels(spark, sf_dir):
    examples = tokens.train_labels(views.prompt_completion_ids(spark, sf_dir, 512), max_len=512)
    return examples.select("doc_id", id_text("input_ids"), id_text("attention_mask"), id_text("labels"))


@query
def collate_pad(spark, sf_dir):
    examples = tokens.train_labels(views.prompt_completion_ids(spark, sf_dir, 512), max_len=512)
    padded = tokens.collate_pad(examples, "doc_id", batch_size=8, pad_id=0)
    return padded.select(
        "batch_id", "doc_id", id_text("input_ids"), id_text("attention_mask"), id_text("labels")
    )
