"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalens.llm.common import WORD, free_name
from stratalens.llm.components import connected_components
from stratalens.llm.words import grouped, mix, shingle_sets
from stratalens.session import save_shared

#: Parameters of the registered query and of the pipeline. Each permutation gives a least and a greatest value;
#: 60 give 24 bands of 5 values: a pair of likeness 0.8 shares no band with probability 7e-5.
PERMUTATIONS = 60
BAND_VALUES = 5
#: Words of a shingle where the caller names none.
WIDTH = 2
#: Linked if 100 * shared >= PERCENT * united shingles.
PERCENT = 80
#: Partners that share one copy of a hub's text, and documents of a block when a bucket is compared in full.
HUB_PARTNERS = 128
BLOCK = 256

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under every permutation ``a * x + b`` of the 64-bit numbers."""
    least = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    greatest = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        values = _FACTORS[:, None] * shingles[None, at : at + 4096] + _SHIFTS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(greatest, values.max(axis=1), out=greatest)
    return np.stack([least, greatest], axis=1).ravel()


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band of consecutive values."""
    bands = signature[: len(signature) // BAND_VALUES * BAND_VALUES].reshape(-1, BAND_VALUES)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for i in range(BAND_VALUES):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return key


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, content (a digest of the whole set, NULL if empty), bands (NULL if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for shingles in shingle_sets(batch.column("text"), width):
                sizes.append(len(shingles))
                some = len(shingles) > 0
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if some else None)
                bands.append(band_keys(min_max_signature(shingles)).view(np.int64) if some else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "content", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, content binary, bands array<long>"
    )


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the likeness."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _spokes(buckets: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges a, b between the least document of each bucket and its other members, confirmed on full sets.

    A hub's text is sent once per ``HUB_PARTNERS`` partners, each partner's once per hub.
    """
    pairs = buckets.where("doc_id <> hub").select("hub", "doc_id").distinct()
    pairs = save_shared(pairs, "near-pairs")
    hubs = save_shared(
        pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_PARTNERS).cast("int").alias("parts")), "near-hubs"
    )
    partners = pairs.join(hubs, "hub").select(
        "doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")
    )
    whole = hubs.select(
        F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("role"),
    )
    roles = save_shared(partners.unionByName(whole), "near-roles")
    texts = roles.hint("merge").join(docs, "doc_id")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "role", "doc_id")))
            for (hub, part, role, doc), own in zip(rows, shingle_sets(batch.column("text"), width)):
                if (hub, part) != at:
                    at, sets = (hub, part), []
                if role == 0:
                    sets.append(own)
                elif any(linked(own, other, percent) for other in sets):
                    found.append((hub, doc))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
            )

    order = ["hub", "part", "role"]
    dealt = texts.repartition("hub", "part").sortWithinPartitions(*order)
    return dealt.select(*order, "doc_id", "text").mapInArrow(confirm, "a long, b long")


def _blocks(buckets: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges a, b between members of a bucket that are in different components, all pairs confirmed on full sets.

    ``buckets``: bucket, doc_id, component. Members of a bucket's largest
    component need no comparison with each other, so it is cut into blocks of
    ``BLOCK`` members, the rest into blocks of its own, and each block of the
    rest meets every block: a piece of work is a pair of blocks (i of the rest,
    j of either). Within it, a document is compared with those not yet in its
    component, and only edges that join components come out.
    """
    parts = buckets.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "component")).alias("main"), F.ceil(F.max("n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("rests"),
    )
    shape = save_shared(shape.select("bucket", F.col("main.component").alias("main"), "mains", "rests"), "bucket-shapes")
    in_main = F.col("component") == F.col("main")
    cut = buckets.join(shape, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.when(in_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    )
    # Blocks are numbered: those of the rest from 0, those of the largest component after them.
    cut = cut.withColumn("own", F.when(in_main, F.col("own") + F.col("rests")).otherwise(F.col("own")))
    last = F.when(in_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    keyed = save_shared(
        cut.select("doc_id", "component", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"),
        "near-blocks",
    )
    keys = ["bucket", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            own, doc, component = (group.column(c).to_numpy() for c in ("own", "doc_id", "component"))
            component = component.copy()
            sets = list(shingle_sets(group.column("text"), width))
            sizes = np.array([len(s) for s in sets])
            flat, at = np.concatenate(sets), np.r_[0, np.cumsum(sizes)]
            apart = group.column("i")[0] != group.column("j")[0]
            found = []
            for k in range(len(sets) - 1):
                rest = np.arange(k + 1, len(sets))
                least, most = np.minimum(sizes[k], sizes[rest]), np.maximum(sizes[k], sizes[rest])
                rest = rest[(component[rest] != component[k]) & (100 * least >= percent * most) & (own[rest] != own[k] if apart else True)]
                if not len(rest) or not sizes[k]:
                    continue
                spans = np.repeat(at[rest] - np.r_[0, np.cumsum(sizes[rest])[:-1]], sizes[rest]) + np.arange(sizes[rest].sum())
                place = np.searchsorted(sets[k], flat[spans])
                hit = sets[k][np.minimum(place, sizes[k] - 1)] == flat[spans]
                shared = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(sizes[rest])[:-1]])
                for other in rest[100 * shared >= percent * (sizes[k] + sizes[rest] - shared)]:
                    if component[other] != component[k]:
                        found.append((doc[k], doc[other]))
                        component[component == component[other]] = component[k]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
            )

    texts = keyed.hint("merge").join(docs, "doc_id")
    dealt = texts.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "own", "doc_id", "component", "text").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A document's set is its distinct shingles of ``width`` words (of fewer words: all of them as one).
    Documents are linked if their sets reach ``percent`` in likeness; a
    component is named by its least doc_id, and that document is kept.

    Equal sets are one class from the start, so copies are never compared.
    Classes that share a band of the min-max signature meet in a bucket:
    first each bucket's least member is compared with the others, then, where
    a bucket still spans several components, all pairs between components.
    Every link is confirmed on the full sets. Buckets with equal members are
    compared once.

    A NULL or wordless text has an empty set and is linked with nothing. Rows
    that repeat an id are one vertex: they share a component. A row without id
    cannot be named as a copy or have any: it is kept, with NULL component. An
    empty table gives an empty result; other columns are not read.
    """
    signed = save_shared(signatures(docs, width), "signed")
    usable = signed.where("doc_id IS NOT NULL AND content IS NOT NULL")
    classes = save_shared(usable.groupBy("content").agg(F.min("doc_id").alias("rep")), "classes")
    copies = usable.select("content", "doc_id").join(classes, "content").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = save_shared(copies.where("a <> b").distinct(), "copies")
    lone = (usable.content == classes.content) & (usable.doc_id == classes.rep)
    bands = usable.join(classes, lone, "left_semi").select("doc_id", F.explode("bands").alias("bucket")).distinct()
    bands = save_shared(bands, "bands")
    buckets = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("hub"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("members"))
        .where("n > 1")
    )
    buckets = save_shared(buckets.groupBy("n", "hub", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "hub"), "buckets")
    members = save_shared(bands.join(buckets, "bucket"), "members")
    # The texts of all documents move once; from here on only those that share a bucket with another one do.
    met = members.select("doc_id").distinct()
    docs = save_shared(docs.select("doc_id", "text").join(met.hint("merge"), "doc_id", "left_semi"), "near-texts")
    links = save_shared(copies.unionByName(_spokes(members, docs, percent, width)), "near-links")
    found = save_shared(connected_components(links), "components")
    placed = members.join(found, members.doc_id == found.vertex, "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    placed = save_shared(placed, "placed-members")
    split = save_shared(
        placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("greatest"))
        .where("least <> greatest").select("bucket"),
        "split-buckets",
    )
    more = save_shared(_blocks(placed.join(split, "bucket"), docs, percent, width), "more-links")
    found = save_shared(connected_components(links.unionByName(more)), "components")
    named = signed.join(found, signed.doc_id == found.vertex, "left")
    component = F.coalesce("component", "doc_id")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component of near-duplicates stays.

    That is the row with the component's least doc_id; of rows that repeat
    this id, the one with the least text. Rows without words or without id stay.
    """
    found = save_shared(near_duplicates(docs, percent, width), "near-duplicates")
    repeats = found.where("kept AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeats = save_shared(repeats.where("doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    left_out = found.where("NOT kept").select("doc_id").distinct().unionByName(repeats)
    once = docs.join(left_out, "doc_id", "left_anti").select(*docs.columns)
    rank = free_name(docs, "_rank")
    first = Window.partitionBy("doc_id").orderBy("text")
    wordy = docs.where(F.regexp_like("text", F.lit(WORD))).join(repeats, "doc_id", "left_semi")
    wordless = docs.where(~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))).join(repeats, "doc_id", "left_semi")
    chosen = wordy.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return once.unionByName(chosen.select(*docs.columns)).unionByName(wordless.select(*docs.columns))
