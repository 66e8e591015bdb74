"""Caption quality: corpus BLEU-4, ROUGE-L, METEOR, and the inspection rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalens.functions import overlap
from stratalens.functions.stem import with_stems
from stratalens.functions.text import UNICODE_SEPARATORS, clean_generated, strip, token_text
from stratalens.operators import coding

EMPTY_MARK = "(empty)"  # fixed value: shown for an empty caption


def match_references(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Generated captions next to the reference captions of their sample."""
    return predictions.join(samples.select("sample_id", "refs"), "sample_id")


def normalise_refs(refs: Column, caption: Column) -> Column:
    """The reference list, or a list of the single caption."""
    return F.coalesce(refs, F.array(caption))


def first_reference(refs: Column) -> Column:
    """Fails on an empty list under ANSI mode, as the metric has no reference then."""
    return refs[0]


_BLEU_FIELDS = [f"{kind}_{n}" for kind in ("match", "total") for n in overlap.ORDERS] + ["pred_len", "ref_len"]


def _bleu_kernel(keys: tuple[str, ...], rule: str, slice_rows: int = 128):
    """A mapInArrow function: the ten BLEU numbers of every sample, next to its keys."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(offset, slice_rows)
                matches, lengths, refs = overlap.clip_counts(batch.column("predicted"), batch.column("references"))
                totals = [np.maximum(lengths - n + 1, 0) for n in overlap.ORDERS]
                nearest = [overlap.reference_length(p, r.tolist(), rule) for p, r in zip(lengths.tolist(), refs)]
                values = [*matches.T, *totals, lengths, np.array(nearest, np.int64)]
                columns = [batch.column(key) for key in keys] + [pa.array(v.astype(np.int64)) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *_BLEU_FIELDS])

    return counts


def bleu4(
    captions: DataFrame, keys: tuple[str, ...] = (), separators: str = UNICODE_SEPARATORS, length_rule: str = "closest"
) -> DataFrame:
    """Corpus BLEU-4 over all references, with the sums it comes from.

    n-grams match within a sample only, so they are counted where the sample
    lies; tasks add up ten numbers and no n-gram is shuffled.
    """
    texts = captions.select(
        *keys,
        token_text(F.col("generated"), separators).alias("predicted"),
        F.transform("refs", lambda ref: token_text(ref, separators)).alias("references"),
    )
    fields = [T.StructField(name, T.LongType()) for name in _BLEU_FIELDS]
    schema = T.StructType([*[texts.schema[key] for key in keys], *fields])
    counted = texts.mapInArrow(_bleu_kernel(keys, length_rule), schema)
    sums = counted.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in _BLEU_FIELDS])
    precisions = [F.col(f"match_{n}") / F.nullif(f"total_{n}", F.lit(0)) for n in overlap.ORDERS]
    log_mean = sum((F.ln(p) for p in precisions), F.lit(0.0)) / len(precisions)
    ratio = F.col("ref_len") / F.nullif("pred_len", F.lit(0))
    brevity = F.when(F.col("pred_len") > F.col("ref_len"), 1.0).otherwise(F.exp(1 - ratio))
    any_zero = F.least(*[F.col(f"match_{n}") for n in overlap.ORDERS]) == 0
    return sums.withColumn("bleu4", F.when(any_zero, 0.0).otherwise(brevity * F.exp(log_mean)))


@F.pandas_udf(T.DoubleType())
def _rouge_l(generated: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([overlap.rouge_l_f1(p.split(), r.split()) for p, r in zip(generated, reference)], dtype=float)


def rouge_l_scores(captions: DataFrame, separators: str = UNICODE_SEPARATORS) -> DataFrame:
    """LCS F1 of every caption with its first reference."""
    predicted = token_text(F.col("generated"), separators)
    reference = token_text(first_reference(F.col("refs")), separators)
    return captions.withColumn("rouge_l", _rouge_l(predicted, reference))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()


def _word_facts(words: DataFrame, stemming: bool, synsets: DataFrame | None) -> DataFrame:
    """Per chunk, in the order of its codes: the stems and the synsets of its words (NULL where not asked for)."""
    distinct = words.select("word").distinct()
    known = with_stems(distinct) if stemming else distinct.withColumn("stem", F.lit(None).cast("string"))
    if synsets is None:
        known = known.withColumn("synsets", F.lit(None).cast("array<string>"))
    else:
        listed = synsets.select("word", F.col("synset").cast("string").alias("synset")).groupBy("word")
        known = known.join(listed.agg(F.collect_set("synset").alias("synsets")), "word", "left")
    return coding.per_chunk(words.join(known, "word"), stems="stem", synsets="synsets")


def meteor_scores(
    captions: DataFrame,
    stemming: bool = True,
    synsets: DataFrame | None = None,
    separators: str = UNICODE_SEPARATORS,
    keys: tuple[str, ...] = ("sample_id",),
) -> DataFrame:
    """``keys`` and the METEOR of every caption with its first reference.

    ``synsets`` holds ``(word, synset)`` rows, words being synonyms if they
    share one; it may have any size. Captions become word codes with a
    dictionary per chunk. Stems are computed once per distinct word; they and
    the synsets meet the dictionaries in a join, so no word is shuffled as often
    as it occurs. A chunk is aligned as a whole, on integers.
    """
    texts = {
        "_predicted": token_text(F.col("generated"), separators),
        "_reference": token_text(first_reference(F.col("refs")), separators),
    }
    names = list(texts)
    if not stemming and synsets is None:  # nothing to look up
        chosen = captions.select(*keys, *[text.alias(name) for name, text in texts.items()])
        schema = T.StructType([*[chosen.schema[key] for key in keys], T.StructField("meteor", T.DoubleType())])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in coding.pieces(whole, names) if whole.num_rows else ():
                    (predicted, n), (reference, m) = (coding.split_words(batch.column(name)) for name in names)
                    codes = pa.concat_arrays([predicted, reference]).dictionary_encode().indices.to_numpy().astype(np.int64)
                    scores = overlap.meteor((codes[: len(predicted)], n), (codes[len(predicted) :], m))
                    yield pa.RecordBatch.from_arrays([*[batch.column(key) for key in keys], pa.array(scores)], names=[*keys, "meteor"])

        return chosen.mapInArrow(exact, schema)

    table, with_synsets = coding.coded(captions, list(keys), texts), synsets is not None
    schema = T.StructType([*[table.schema[key] for key in keys], T.StructField("meteor", T.DoubleType())])

    def align(rows: pa.Table, facts: pa.Table) -> pa.Table:
        stages = {}
        if facts.num_rows and stemming:
            stems = facts.column("stems").combine_chunks().flatten().dictionary_encode()
            stages["stems"] = stems.indices.to_numpy().astype(np.int64)
        if facts.num_rows and with_synsets:
            lists = facts.column("synsets").combine_chunks().flatten()
            codes = lists.flatten().dictionary_encode().indices.to_pylist()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            stages["synsets"] = [codes[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        scores = [overlap.meteor(*(_lists(part, name) for name in names), **stages) for part in coding.steps(rows, names)]
        return pa.Table.from_arrays([*[rows.column(key) for key in keys], pa.array(np.concatenate(scores))], names=[*keys, "meteor"])

    facts = _word_facts(coding.chunk_words(table), stemming, synsets)
    return coding.with_facts(table.drop("_words"), facts, align, schema)


def mean_score(scores: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.avg(name).alias(name))


def comparison_rows(captions: DataFrame) -> DataFrame:
    """What an inspection report shows per sample (``sample_idx``, ``coco_id``, captions)."""
    generated = clean_generated(F.col("generated"))
    return captions.select(
        "sample_idx",
        "coco_id",
        F.when(generated == "", EMPTY_MARK).otherwise(generated).alias("generated"),
        F.transform("refs", strip).alias("refs"),
        F.size("refs").alias("n_refs"),
        F.format_string("sample_%03d_coco%d.jpg", "sample_idx", "coco_id").alias("img_file"),
    )
