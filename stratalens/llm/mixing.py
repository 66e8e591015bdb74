"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.llm.common import free_name, n_words, running_totals
from stratalens.operators.rows import shuffle_key
from stratalens.session import save_shared

#: Parameters of the registered query and of the pipeline.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
SEED = 10


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``source_no`` and ``target``.

    Sources by code point, NULL last, take the weights in turn and share
    ``budget`` times all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight. That is a common level per
    unit of weight, ``target = least(cap, level * weight)``: with the sources
    sorted by cap per weight, the level is the highest that any cut between
    capped and open sources gives. One row per source stands in one window.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    filling = whole.orderBy("_ratio", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(named) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    capped = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * budget - capped) / open_weight
    levelled = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return levelled.select(
        "source", "source_no", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target")
    )


def fair_queue(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST_COPIES,
    seed: int = SEED,
    size: Column | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, rows, source_size, target, copies.

    Documents of a source are shuffled by a seeded hash of their id and served
    up to ``most`` times over. A copy's virtual finish time is the source's
    words up to its end over the source's target; all copies are sorted by it
    and the queue is cut where the words exceed the budget. ``size`` is the
    size of a document (its words unless given).

    Rows alike in doc_id, source and size are one entry with ``rows`` of them,
    taken or left together. A NULL text has size 0 and takes no words, a NULL
    source is a source of its own, a NULL id is an id; an empty table gives an
    empty result. Other columns are not read.
    """
    size = n_words(F.col("text")) if size is None else size
    units = save_shared(
        docs.select("doc_id", "source", size.alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows")),
        "mix-units",
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    shares = save_shared(targets(sizes, weights, budget, most), "mix-targets")
    entries = (
        units.join(shares, units["source"].eqNullSafe(shares["source"]))
        .drop(shares["source"])
        .withColumn("_words", F.col("size") * F.col("rows"))
        .withColumn("_key", shuffle_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))
    )
    queued = save_shared(
        running_totals(entries, ["_key", "size"], "_words", "source_no").withColumnRenamed("total", "_end"),
        "mix-queue",
    )
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_round")
    copies = queued.select("source_no", "source_size", "target", "_end", "_words", "_key", "size", rounds)
    copies = copies.withColumn("_finish", _finish(F.col("_round"))).drop("source_size", "target", "_end")
    order = ["_finish", "source_no", "_round", "_key", "size"]
    served = running_totals(copies, order, "_words")
    total = F.sum("source_size").alias("total")
    limit = int((shares.agg(total).first()["total"] or 0) * budget)
    # Of a source, entries with the same key differ in size at most, so these columns tell all copies apart.
    place = F.struct("_finish", "source_no", "_round", "_key", "size")
    cut = served.where(F.col("total") <= limit).agg(F.max(place).alias("cut")).first()["cut"]

    def taken(k: int) -> Column:
        if cut is None:
            return F.lit(0)
        own = F.struct(_finish(F.lit(k)), F.col("source_no"), F.lit(k), F.col("_key"), F.col("size"))
        kinds = ("double", "int", "int", "string", "long")
        return (own <= F.struct(*[F.lit(x).cast(kind) for x, kind in zip(cut, kinds)])).cast("int")

    copies_of = sum((taken(k) for k in range(1, most)), taken(0))
    return queued.select("doc_id", "source", "size", "rows", "source_size", "target", copies_of.alias("copies"))


def _finish(k: Column) -> Column:
    """Virtual finish time of copy ``k``; a source without words is served at once."""
    end = (F.col("_end") + k * F.col("source_size")).cast("double")
    return F.when(F.col("target") > 0, end / F.col("target")).otherwise(0.0)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``fair_queue`` takes it.

    A document without words is never taken: it adds nothing to a mix by words.
    """
    size, copy = free_name(docs, "_size"), free_name(docs, "_copy")
    found = fair_queue(docs, **options).where("copies > 0 AND size > 0")
    found = found.select(
        F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("copies").alias("_c")
    )
    sized = docs.withColumn(size, n_words(F.col("text")))
    same = docs["doc_id"].eqNullSafe(found["_i"]) & docs["source"].eqNullSafe(found["_s"]) & (sized[size] == found["_n"])
    joined = sized.join(found, same).withColumn(copy, F.explode(F.sequence(F.lit(1), found["_c"])))
    return joined.select(*[docs[name] for name in docs.columns])
