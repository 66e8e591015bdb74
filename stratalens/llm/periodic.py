"""Periodic runs of words by uniting suffix classes in order of descending common prefix."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalens.llm.common import WORD, crc32_of
from stratalens.session import spread

#: Parameters of the registered query: words and periods that a run has at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that a task handles in one step (a longer text is a step of its own).
STEP_WORDS = 150_000


def suffix_order(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose first four ids occur again, in the order of their suffixes, and the ids each shares with the one before.

    Ranks by 1, 2, 4, 8, ... ids (prefix doubling); from 4 on only positions
    that are still equal to another one are sorted again. The shared length is
    read off the ranks of all levels. Pairs that share fewer than ``least``
    (4 or more) get some smaller number.
    """
    n = len(ids)
    past = np.full(1, -1)
    levels = [(1, np.r_[ids, past])]
    for step in (1, 2):
        rank = levels[-1][1]
        after = rank[np.minimum(np.arange(n) + step, n)]
        rank = np.unique(rank[:-1] * (n + 1) + after + 1, return_inverse=True)[1]
        levels.append((2 * step, np.r_[rank, past]))
    counts = np.bincount(rank, minlength=1)
    rank = (np.cumsum(counts) - counts)[rank]  # places in the order of all suffixes
    levels[-1] = (4, np.r_[rank, past])
    own = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    open_, step = own, 4
    while len(open_):
        rank = levels[-1][1]
        first, second = rank[open_], rank[np.minimum(open_ + step, n)]
        order = np.lexsort((second, first))
        open_, first, second = open_[order], first[order], second[order]
        row = np.arange(len(open_))
        outer = np.r_[True, first[1:] != first[:-1]]
        inner = outer | np.r_[True, second[1:] != second[:-1]]
        outer, begins = np.maximum.accumulate(np.where(outer, row, 0)), np.flatnonzero(inner)
        rank = rank.copy()
        rank[open_] = first + np.maximum.accumulate(np.where(inner, row, 0)) - outer
        open_ = open_[np.repeat(np.diff(np.r_[begins, len(open_)]) > 1, np.diff(np.r_[begins, len(open_)]))]
        step *= 2
        levels.append((step, rank))
    order = own[np.argsort(levels[-1][1][own])]
    a, b = order[:-1].copy(), order[1:].copy()
    for step, rank in reversed(levels):
        same = rank[a] == rank[b]
        a += step * same
        b += step * same
    return order, np.r_[0, a - order[:-1]] if len(order) else np.zeros(0, dtype=np.int64)


def _unite(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Merge ``small`` into ``large``, both ascending; the pairs, one from each, that become neighbours."""
    places = [bisect_left(large, x) for x in small]
    n = len(large)
    for k, (x, place) in enumerate(zip(small, places)):
        if place and (not k or places[k - 1] != place):
            yield large[place - 1], x
        if place < n and (k + 1 == len(small) or places[k + 1] != place):
            yield x, large[place]
    if 8 * len(small) > n:
        large.extend(small)
        large.sort()
    else:
        for x in small:
            insort(large, x)


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """start, length, period of every run in a sequence of integers from 0 up to below its length, ascending.

    A run of period p and length m starts at s: then s and s + p are
    neighbours in the class of positions that share m - p ids, and no further
    ones. So classes are united in the order of descending common prefixes
    (Kruskal on the path of sorted suffixes), the positions of a class kept in
    order; each two positions that become neighbours at a distance not above
    the common prefix make a seed, which is a run unless it goes on to its left.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    order, shared = suffix_order(ids, 4)
    # Shortest common prefix of a run's first two periods; four ids are what suffix_order tells apart from less.
    least = min(max((least_periods - 1) * p, least_words - p) for p in range(1, least_words + 1))
    if least < 4:
        raise ValueError("runs of this length need common prefixes below four")
    edges = np.flatnonzero(shared >= least)
    if not len(edges):
        return []
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    position, before = order.tolist(), ids.tolist()
    parent = list(range(len(position)))
    members: list[list[int] | None] = [None] * len(position)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for edge, common in zip(edges.tolist(), shared[edges].tolist()):
        a, b = root(edge - 1), root(edge)
        first, second = members[a] or [position[a]], members[b] or [position[b]]
        if len(first) < len(second):
            a, b, first, second = b, a, second, first
        parent[b], members[a], members[b] = a, first, None
        for x, y in _unite(first, second):
            period = y - x
            length = common + period
            if length >= least_periods * period and length >= least_words and (x == 0 or before[x - 1] != before[y - 1]):
                found.append((x, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _first_places(words: list[bytes], base: int) -> np.ndarray:
    """For each word ``base`` and the place where it occurs first."""
    places: dict[bytes, int] = {}
    return np.fromiter(map(places.setdefault, words, range(base, base + len(words))), dtype=np.int64, count=len(words))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of ``docs`` (doc_id, text).

    Words are runs of anything but the space and the five ASCII line and tab
    controls, compared exactly. A run is a stretch of words with smallest
    period p, at least ``least_words`` and ``least_periods`` * p long, which no
    neighbouring word extends. ``collapsed`` is the text without the words that
    a run has after its first period, joined by one space.

    No shuffle: a text's runs depend on it alone. A task handles some texts at
    once, one long text at the most. NULL and empty texts have no words, no
    runs and the empty collapsed text; repeated rows are rows of their own; an
    empty table gives an empty result; other columns are not looked at.
    """

    def find(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
        bases = np.cumsum([0, *map(len, texts)])
        ids = [_first_places(words, int(base)) for words, base in zip(texts, bases)]
        own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        found = runs_of(np.concatenate(ids), least_words, least_periods) if bases[-1] else []
        text = (np.searchsorted(bases, [start for start, _, _ in found], side="right") - 1).tolist()
        for k, (start, length, period) in zip(text, found):
            own[k].append((start - int(bases[k]), length, period))
        for words, runs in zip(texts, own):
            yield runs, _collapsed(words, runs)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = list(find(texts))
        runs = [[{"start": s, "length": m, "period": p} for s, m, p in runs] for runs, _ in found]
        columns = [pa.concat_arrays(ids), pa.array(list(map(len, texts)), pa.int64()), pa.array(runs, kind), pa.array([c for _, c in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for row in range(batch.num_rows):
                words = (column[row].as_py() or b"").split()
                if texts and n + len(words) > STEP_WORDS:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(batch.column("doc_id").slice(row, 1))
                texts.append(words)
                n += len(words)
        if texts:
            yield rows(ids, texts)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(detect, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where a tenth of the documents, told by the CRC-32 of the id, ends in repetitions of its own words.

    With h the CRC-32 (of a NULL id: 0), g = h // 10 and n words, a document with
    h % 10 = 0 repeats from word a = g % n on its next
    1 + (n - a) // (3 + g % 8) words up to its old length.
    """
    h = crc32_of(F.col("doc_id"))
    chosen = docs.select("doc_id", "text", h.alias("_h"), (F.floor(h / 10)).alias("_g"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("_words")
    cut = chosen.withColumn("_words", words).withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rest = n - F.col("_a")
    cut = cut.withColumn("_p", 1 + F.floor(rest / (3 + F.col("_g") % 8)))
    once = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(once, F.ceil(rest / F.col("_p")).cast("int"))), 1, rest.cast("int"))
    planted = F.array_join(F.concat(F.slice("_words", 1, F.col("_a").cast("int")), tail), " ")
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length, of those the one with the smallest start, then period; NULL if there is none."""
    keys = F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(keys)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["k"]).alias("length"), best["period"].alias("period")))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed of every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
