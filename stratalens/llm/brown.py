"""Language-model scores by Brown classes: class bigrams and word emissions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalens.llm.common import crc32_of
from stratalens.llm.words import mix, steps, word_hashes
from stratalens.session import save_shared

#: Parameters of the registered query. The classes start from at most UNITS words and ENDINGS groups by the last two
#: bytes of the others; then every word moves by its own counts: the RESIDENT most frequent ones, whose classes are in
#: every task, in ROUNDS rounds, the first of which takes them in PARTS turns, each later one in one more (a turn that
#: overshoots is halved DAMPED times at most); after them all rarer ones once.
UNITS = 512
ROUNDS = 2
PARTS = 2
DAMPED = 1
ENDINGS = 128
CLASSES = 50
RESIDENT = 200_000
EXCHANGES = 8
#: Tokens that a task counts before it passes on the counts of neighbours, and of words alone; cells of one word that it holds before it adds them up, and
#: tasks among which the counts of a frequent word are dealt.
COUNTED = 2_000_000
COUNTED_WORDS = 4_000_000
HELD_CELLS = 1 << 20
SPLIT = 16
#: Added to counts of units and words, and the weight of the class frequencies in a class's transitions.
ADDED = 0.5
BACKOFF = 10.0

END = np.uint64(0x9D5C0F6E3A1B2847)


def is_training(doc_id: Column) -> Column:
    return crc32_of(doc_id) % 5 != 1


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, token hashes, group of each by its ending, and token offsets of its rows, for slices of a text column.

    Every text ends in the end token; NULL is the empty text. Words are known
    by a 64-bit hash.
    """
    for row, data, offsets in steps(column):
        words, counts, endings = word_hashes(data, offsets)
        bounds = np.cumsum(counts)
        group = (mix(endings.astype(np.uint64) + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)
        yield row, np.insert(words, bounds, END), np.insert(group, bounds, 0), np.r_[0, bounds + np.arange(1, len(counts) + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, ending, n: the tokens of all ``docs``, counted in the tasks and then by shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, hashes, group, _ in tokens(batch.column("text")):
                held.append((hashes, group))
                if sum(len(hashes) for hashes, _ in held) >= COUNTED_WORDS:
                    yield distinct(held)
                    held = []
        if held:
            yield distinct(held)

    def distinct(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, first, n = np.unique(np.concatenate([hashes for hashes, _ in held]), return_index=True, return_counts=True)
        group = np.concatenate([group for _, group in held])[first]
        return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "ending": pa.array(group), "n": pa.array(n)})

    counted = docs.select("text").mapInArrow(count, "word long, ending long, n long")
    return counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _least_count(vocabulary: DataFrame, most: int) -> int:
    """The least of the counts 2 ** (k / 8) that at most ``most`` words reach."""
    octave = F.floor(F.log2("n") * 8).cast("int").alias("octave")
    found = vocabulary.groupBy(octave).agg(F.count("*").alias("words")).collect()  # some 500 rows at most
    total, least = 0, 2**62
    for row in sorted(found, reverse=True):
        total += row["words"]
        if total > most:
            break
        least = 2 ** (row["octave"] / 8)
    return int(np.ceil(least - 1e-9))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, rounds: int = EXCHANGES) -> np.ndarray:
    """The class of every unit from the counts of unit pairs, by the exchange algorithm (Martin et al., 1998).

    Units, the most frequent first, start in turn in all classes. Each unit in
    turn moves to the class that gives the highest likelihood of the class
    bigrams, until a round moves none or ``rounds`` are done.
    """
    units = len(pairs)
    order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
    of = np.empty(units, dtype=np.int64)
    of[order] = np.arange(units) % classes
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    left, right = table.sum(axis=0), table.sum(axis=1)

    for _ in range(rounds):
        moved = 0
        for u in order:
            before, after = pairs[:, u] @ member, pairs[u] @ member
            own, a = pairs[u, u], of[u]
            before[a] -= own
            after[a] -= own
            comes, goes = pairs[:, u].sum(), pairs[u].sum()
            table[:, a] -= before
            table[a] -= after
            table[a, a] -= own
            left[a] -= comes
            right[a] -= goes
            gain = (_f(table + after[None, :]) - _f(table)).sum(axis=1) + (_f(table + before[:, None]) - _f(table)).sum(axis=0)
            corner, both = np.diag(table), before + after + own
            gain += _f(corner + both) - _f(corner) - (_f(corner + after) - _f(corner)) - (_f(corner + before) - _f(corner))
            gain -= _f(left + comes) - _f(left) + _f(right + goes) - _f(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            member[u, a], member[u, b], of[u] = 0, 1, b
            table[:, b] += before
            table[b] += after
            table[b, b] += own
            left[b] += comes
            right[b] += goes
            moved += b != a
        if not moved:
            break
    return of


class Units:
    """The units of clustering: frequent words, the end token, and one per group of endings for all other words."""

    def __init__(self, words: np.ndarray):
        self.words = np.union1d(words, [END]).astype(np.uint64)
        self.n = len(self.words) + ENDINGS

    def of(self, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words) + group)


def pair_counts(texts: DataFrame, words: np.ndarray, unit_of: np.ndarray, n_units: int) -> np.ndarray:
    """How often each unit follows each other one. A task sends at most one row for each pair, and so does the result."""
    known = texts.sparkSession.sparkContext.broadcast((words, unit_of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unit_of = known.value
        total = np.zeros(n_units**2, dtype=np.int64)
        end = int(unit_of[np.searchsorted(words, END.view(np.int64))])
        for ids, _, ending in _encoded_rows(batches):  # every row ends in an end
            unit = unit_of[ids]
            unit[ids < 0] = n_units - ENDINGS + ending.astype(np.int64)
            total += np.bincount(np.r_[end, unit[:-1]] * n_units + unit, minlength=len(total))
        pair = np.flatnonzero(total)
        for at in range(0, len(pair), 100_000):
            part = pair[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"pair": pa.array(part), "n": pa.array(total[part])})

    found = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return _table_of(found.toArrow(), n_units)  # at most (UNITS + 1 + ENDINGS) ** 2 rows


def transitions(table: np.ndarray, used: np.ndarray) -> np.ndarray:
    """log10 of P(class | class before), smoothed by the class frequencies; a class not ``used`` has no share."""
    class_n = table.sum(axis=0)
    share = np.where(used, class_n + ADDED, 0)
    share = share / share.sum()
    with np.errstate(divide="ignore"):
        return np.log10((table + BACKOFF * share) / (table.sum(axis=1, keepdims=True) + BACKOFF))


class WordModel:
    """log10 of class transitions and the parts of P(word | class) = (n + 0.5) / (N_class + 0.5 * (V_class + G_class)).

    V_class are the training words of the class, G_class the groups of endings
    whose unknown words it has: one unknown word of each group has its share. All sum up to 1.
    """

    def __init__(self, table: np.ndarray, words_of: np.ndarray, group_class: np.ndarray):
        classes = len(table)
        kinds = words_of + np.bincount(group_class, minlength=classes)
        self.group_class = group_class
        self.transition = transitions(table, kinds > 0)
        self.divisor = np.log10(np.maximum(table.sum(axis=0) + ADDED * kinds, ADDED))


#: Leading bits of a hash that lead to its place in a sorted array.
LEADING = 18


def leading(words: np.ndarray) -> np.ndarray:
    """For each value of the leading bits the place in the sorted ``words`` where hashes with them begin."""
    edges = (np.arange(1 << LEADING, dtype=np.int64) - (1 << LEADING - 1)) << np.int64(64 - LEADING)
    return np.searchsorted(words, edges)


def places(words: np.ndarray, hashes: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is in the sorted ``words``, and whether it is there; for many hashes pass ``leading(words)``."""
    hashes = hashes.view(np.int64)
    if first is None:
        at = np.searchsorted(words, hashes)
    else:
        at = first[(hashes >> np.int64(64 - LEADING)) + (1 << LEADING - 1)]
        open_ = np.flatnonzero(words[np.minimum(at, len(words) - 1)] < hashes)
        while len(open_):  # a few words share their leading bits
            open_ = open_[at[open_] < len(words)]
            at[open_] += 1
            open_ = open_[words[np.minimum(at[open_], len(words) - 1)] < hashes[open_]]
    at = np.minimum(at, len(words) - 1)
    return at, words[at] == hashes


def encoded(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """ids, rare, ending: all texts as places in ``words``, -1 for any other word; the hashes of those in order, and their groups."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = leading(known.value)
        for batch in batches:
            for _, hashes, group, _ in tokens(batch.column("text")):
                at, here = places(known.value, hashes, first)
                parts = np.where(here, at, -1).astype(np.int32), hashes[~here], group[~here].astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in parts], names=["ids", "rare", "ending"])

    return docs.select("text").mapInArrow(encode, "ids binary, rare binary, ending binary")


def _encoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "rare", "ending"))):
            yield tuple(np.frombuffer(x, dtype=kind) for x, kind in zip(row, (np.int32, np.int64, np.int16)))


def _neighbours(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of neighbours, the rare words and their groups, for a bounded number of tokens at a time; rare words have ids from len(words) on."""
    end = int(np.searchsorted(words, END.view(np.int64)))

    def of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, rare, ending = (np.concatenate(x) for x in zip(*held))
        ids = ids.astype(np.int64)
        rare, first, own = np.unique(rare, return_index=True, return_inverse=True)
        ids[ids < 0] = len(words) + own
        return np.r_[end, ids[:-1]], ids, rare, ending[first].astype(np.int64)  # every row ends in an end

    held, n = [], 0
    for row in _encoded_rows(batches):
        held.append(row)
        n += len(row[0])
        if n >= COUNTED:
            yield of(held)
            held, n = [], 0
    if held:
        yield of(held)


def _table_of(found: pa.Table, classes: int) -> np.ndarray:
    table = np.zeros(classes**2)
    np.add.at(table, found["pair"].to_numpy(), found["n"].to_numpy())
    return table.reshape(classes, classes)


class Contexts:
    """Where the cells of a word's context stand: n * stride + key.

    Keys are in turn the place in ``words`` of the word before it, or the group of
    a rare word before it, the same for the word after it, and the word beside itself.
    """

    @staticmethod
    def stride(n_words: int) -> int:
        return 2 * (n_words + ENDINGS) + 1

    @staticmethod
    def columns(class_of: np.ndarray, group_class: np.ndarray, classes: int) -> np.ndarray:
        """The column of each key in a row of 4 * classes + 1: classes before it, of one of ``words`` or a rare word, and after it."""
        side = np.r_[class_of, classes + group_class]
        return np.r_[side, 2 * classes + side, 4 * classes]


def contexts(texts: DataFrame, words: np.ndarray, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """word, ending, cells of ``words`` (ending -1) and of all rare words: how often each word, or group of rare words, stands beside it.

    These counts hold whatever the classes are. A task sends at most one row
    for each word and ``COUNTED`` tokens; the rows of the ``frequent`` words are
    dealt among ``SPLIT`` tasks first.
    """
    n_words, stride = len(words), Contexts.stride(len(words))
    known = texts.sparkSession.sparkContext.broadcast((words, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, frequent = known.value
        salt = TaskContext.get().partitionId() % SPLIT
        dealt = np.where(np.isin(words, frequent), salt, 0).astype(np.int32)
        for left, right, others, ending in _neighbours(batches, words):
            key = np.r_[np.arange(n_words), n_words + ending]
            code = np.r_[right * stride + key[left], left * stride + n_words + ENDINGS + key[right], right[left == right] * stride + stride - 1]
            code, n = np.unique(code, return_counts=True)
            word = code // stride
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            cells, ends = n * stride + code - word * stride, np.r_[starts[1:], len(code)]
            names = np.r_[words, others]
            groups = np.r_[np.full(n_words, -1), ending].astype(np.int32)
            salts = np.r_[dealt, np.zeros(len(others), np.int32)]
            for at in range(0, len(starts), 20_000):
                first, last = starts[at : at + 20_000], ends[at : at + 20_000]
                own = word[first]
                offsets = (np.r_[first, last[-1]] - first[0]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[first[0] : last[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[own]), pa.array(groups[own]), lists, pa.array(salts[own])], names=["word", "ending", "cells", "salt"]
                )

    def added(table: pa.Table) -> pa.Table:
        names, first, at = np.unique(table["word"].to_numpy(), return_index=True, return_inverse=True)
        lists = table["cells"].combine_chunks()
        lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        code, place = np.unique(np.repeat(at, lengths) * stride + values % stride, return_inverse=True)
        n = np.bincount(place, weights=values // stride, minlength=len(code)).astype(np.int64)
        offsets = np.searchsorted(code, np.arange(len(names) + 1) * stride).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(n * stride + code % stride))
        return pa.Table.from_arrays([pa.array(names), pa.array(table["ending"].to_numpy()[first]), lists], names=["word", "ending", "cells"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            names = table["word"].to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            held = table.slice(cut).combine_chunks()
            if held["cells"].nbytes > 8 * HELD_CELLS:
                held = added(held)
            if cut:
                yield from added(table.slice(0, cut).combine_chunks()).to_batches()
        if held is not None:
            yield from added(held).to_batches()

    kinds = "word long, ending int, cells array<long>"
    dealt = texts.mapInArrow(count, f"{kinds}, salt int").repartition("word", "salt").sortWithinPartitions("word")
    found = save_shared(dealt.drop("salt").mapInArrow(add_up, kinds), "contexts")
    split = F.col("word").isin([int(word) for word in frequent])
    whole = found.where(split).repartition("word").sortWithinPartitions("word").mapInArrow(add_up, kinds)
    resident = found.where(F.col("ending") < 0).where(~split).unionByName(whole)
    return save_shared(resident, "resident-contexts"), found.where("ending >= 0")


def _dense(batch: pa.RecordBatch, columns: np.ndarray) -> np.ndarray:
    """The cells of a batch as words x columns of classes."""
    width, lists = int(columns[-1]) + 1, batch.column("cells")
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    place = row * width + columns[values % len(columns)]
    return np.bincount(place, weights=values // len(columns), minlength=len(batch) * width).reshape(len(batch), width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 1024):
            yield batch.slice(start, 1024)


def class_table(found: DataFrame, words: np.ndarray, class_of: np.ndarray, group_class: np.ndarray, classes: int, rare: bool) -> np.ndarray:
    """How often each class follows each other one where one of both is among ``words``, from their contexts; without ``rare``, where both are."""
    known = found.sparkSession.sparkContext.broadcast((words, class_of, group_class))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, class_of, group_class = known.value
        columns, total = Contexts.columns(class_of, group_class, classes), np.zeros((classes, classes))
        for part in _parts(batches):
            own = np.eye(classes)[class_of[places(words, part.column("word").to_numpy())[0]]]
            before, rare_before, _, rare_after = np.split(_dense(part, columns)[:, :-1], 4, axis=1)
            total += (before + rare_before if rare else before).T @ own
            if rare:
                total += own.T @ rare_after
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total.ravel()[pair].astype(np.int64))})

    counted = found.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return _table_of(counted.toArrow(), classes)


def rare_table(found: DataFrame, group_class: np.ndarray, classes: int, n_words: int) -> np.ndarray:
    """How often each class follows each other one where both words are rare and have the class of their ending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, total = Contexts.columns(np.zeros(n_words, np.int64), group_class, classes), np.zeros((classes, classes))
        for part in _parts(batches):
            own = np.eye(classes)[group_class[part.column("ending").to_numpy()]]
            total += _dense(part, columns)[:, classes : 2 * classes].T @ own
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total.ravel()[pair].astype(np.int64))})

    counted = found.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return _table_of(counted.toArrow(), classes)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, without the part that no choice of classes changes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def gains(own: np.ndarray, before: np.ndarray, after: np.ndarray, beside: np.ndarray, table: np.ndarray) -> np.ndarray:
    """words x classes: what the likelihood gains if a word, taken out of its class, joins each class; all others stay."""
    every, total = np.arange(len(own)), before.sum(axis=1)
    before, after = before.copy(), after.copy()
    before[every, own] -= beside
    after[every, own] -= beside
    gain = np.zeros(before.shape)
    for here, there, cells in ((after, before, table), (before, after, table.T)):
        word, c = np.nonzero(here > 0)
        n = here[word, c][:, None]
        left = cells[:, c].T - np.where((c == own[word])[:, None], there[word], 0)
        left[np.arange(len(word)), own[word]] -= n[:, 0] + np.where(c == own[word], beside[word], 0)
        if len(word):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[starts]] += np.add.reduceat(_f(left + n) - _f(left), starts)
    corner = np.tile(np.diag(table), (len(own), 1))
    corner[every, own] -= before[every, own] + after[every, own] + beside
    both = before + after + beside[:, None]
    gain += _f(corner + both) + _f(corner) - _f(corner + after) - _f(corner + before)
    for margin in (table.sum(axis=0), table.sum(axis=1)):
        left = np.tile(margin, (len(own), 1))
        left[every, own] -= total
        gain -= _f(left + total[:, None]) - _f(left)
    return gain


def moved(
    found: DataFrame, words: np.ndarray, class_of: np.ndarray, group_class: np.ndarray, table: np.ndarray, turn: tuple[int, int] | None
) -> DataFrame:
    """word, class of those of ``words`` that move to a better class in a turn (which one, of how many), all at once; ``found`` has their contexts.

    Without ``turn``, of the contexts of rare words: word, ending, class, n, cells of each, in its best class.
    """
    classes = len(table)
    known = found.sparkSession.sparkContext.broadcast((words, class_of, group_class, table))

    def best(part: pa.RecordBatch, columns: np.ndarray, own: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dense = _dense(part, columns)
        before, after = (dense[:, k : k + classes] + dense[:, k + classes : k + 2 * classes] for k in (0, 2 * classes))
        gain = gains(own, before, after, dense[:, -1], table)
        first, every = gain.argmax(axis=1), np.arange(len(own))
        return np.where(gain[every, first] > gain[every, own] + 1e-6, first, own), before.sum(axis=1)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, class_of, group_class, table = known.value
        columns = Contexts.columns(class_of, group_class, classes)
        for part in _parts(batches):
            names = part.column("word").to_numpy()
            if turn is None:
                to, n = best(part, columns, group_class[part.column("ending").to_numpy()], table)
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), part.column("ending"), pa.array(to.astype(np.int32)), pa.array(n.astype(np.int64)), part.column("cells")],
                    names=["word", "ending", "class", "n", "cells"],
                )
                continue
            mine = mix(names.view(np.uint64)) % np.uint64(turn[1]) == turn[0]
            part, names = part.filter(pa.array(mine)), names[mine]
            if len(names):
                own = class_of[places(words, names)[0]]
                to, _ = best(part, columns, own, table)
                go = to != own
                yield pa.RecordBatch.from_arrays([pa.array(names[go]), pa.array(to[go].astype(np.int32))], names=["word", "class"])

    if turn is None:
        return found.mapInArrow(move, "word long, ending int, class int, n long, cells array<long>")
    return found.mapInArrow(move, "word long, class int")


def word_classes(
    texts: DataFrame, words: np.ndarray, frequent: np.ndarray, class_of: np.ndarray, group_class: np.ndarray, classes: int
) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Classes of ``words``; word, ending, class, n of all other training words; and the class table.

    The start are the classes ``class_of`` the words and ``group_class`` of the
    endings of the others. The contexts of all words are counted once. In a
    round every one of ``words`` has its turn; a turn stands if the likelihood has
    grown by it, else fewer of its words move, and a round in which none stands
    is the last. The rare words,
    which have the class of their ending in the contexts of others, move once,
    against the table of the last round.
    """
    found, others = contexts(texts, words, frequent)
    fixed = rare_table(others, group_class, classes, len(words))  # while words move
    table = fixed + class_table(found, words, class_of, group_class, classes, rare=True)
    for turns in range(PARTS, PARTS + ROUNDS):
        stands = False
        for turn in range(turns):
            gone = moved(found, words, class_of, group_class, table, (turn, turns)).toArrow()  # at most RESIDENT + UNITS + 1 rows
            at, to = places(words, gone["word"].to_numpy())[0], gone["class"].to_numpy()
            for damped in range(DAMPED + 1):  # too many at once can make it worse: then a half of them, a quarter, ...
                tried, go = class_of.copy(), mix(words[at].view(np.uint64) + np.uint64(turns)) % np.uint64(1 << damped) == 0
                tried[at[go]] = to[go]
                after = fixed + class_table(found, words, tried, group_class, classes, rare=True)
                if likelihood(after) > likelihood(table):
                    class_of, table, stands = tried, after, True
                    break
        if not stands:
            break
    rare = save_shared(moved(others, words, class_of, group_class, table, None), "rare-classes")
    columns = Contexts.columns(class_of, group_class, classes)

    def beside_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, classes))
        for part in _parts(batches):
            dense, own = _dense(part, columns), np.eye(classes)[part.column("class").to_numpy()]
            total += dense[:, :classes].T @ own + own.T @ dense[:, 2 * classes : 3 * classes]
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total.ravel()[pair].astype(np.int64))})

    def both_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names, _ in _encoded_rows(batches):
            at = np.flatnonzero(ids < 0)
            beside = np.flatnonzero(np.diff(at) == 1)
            yield pa.RecordBatch.from_pydict({"a": pa.array(names[beside]), "b": pa.array(names[beside + 1])})

    table = class_table(found, words, class_of, group_class, classes, rare=False)
    found = rare.select("class", "cells").mapInArrow(beside_words, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = table + _table_of(found.toArrow(), classes)
    pairs = texts.mapInArrow(both_rare, "a long, b long")
    for word, own in (("a", "ac"), ("b", "bc")):
        pairs = pairs.join(rare.select(F.col("word").alias(word), F.col("class").cast("long").alias(own)), word)
    found = pairs.groupBy((F.col("ac") * classes + F.col("bc")).alias("pair")).agg(F.count("*").alias("n"))
    return class_of, rare.select("word", "ending", "class", "n"), table + _table_of(found.toArrow(), classes)


def scores(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs``.

    Read are doc_id and text. Learned from are all documents whose
    crc32(doc_id) mod 5 is not 1. Words are counted over all of them. The
    frequent ones and groups of endings of the others are clustered by the
    exchange algorithm on their pair counts, a bounded table; from these
    classes on, every training word moves by its own counts. A word unseen in
    training has the class that most training words of its ending have.
    Scoring adds up in the tasks all that needs bounded tables; the counts and
    classes of rare words are joined by shuffle.

    A NULL or empty text is one end token. A NULL id counts as the empty text
    in the split. Repeated rows are learned from and scored each. Without
    training documents every token is unknown and the base score 0. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", "text")
    training = read.where(is_training(F.col("doc_id")))
    vocabulary = save_shared(word_counts(training), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = vocabulary.where(F.col("n") >= _least_count(vocabulary, UNITS)).select("word").toArrow()
    units = Units(frequent["word"].to_numpy().view(np.uint64))
    of_units = [int(word) for word in units.words.view(np.int64)]
    resident = vocabulary.where((F.col("n") >= _least_count(vocabulary, RESIDENT)) | F.col("word").isin(of_units))
    resident = resident.toArrow()  # at most RESIDENT + UNITS + 1 rows
    words = np.union1d(resident["word"].to_numpy(), [END.view(np.int64)])
    counts, ending = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    at, _ = places(words, resident["word"].to_numpy())
    counts[at], ending[at] = resident["n"].to_numpy(), resident["ending"].to_numpy()
    texts, unit_of = save_shared(encoded(training, words), "encoded"), units.of(words.view(np.uint64), ending)
    unit_class = exchange(pair_counts(texts, words, unit_of, units.n), classes)
    class_of, rare, table = word_classes(
        texts, words, units.words.view(np.int64), unit_class[unit_of], unit_class[len(units.words) :], classes
    )

    kinds = np.zeros((ENDINGS, classes))
    np.add.at(kinds, (ending, class_of), 1)  # the end is a word even if nothing is learned
    for row in rare.groupBy("ending", "class").agg(F.count("*").alias("v")).collect():  # at most ENDINGS * CLASSES rows
        kinds[row["ending"], row["class"]] += row["v"]
    group_class = np.where(kinds.any(axis=1), kinds.argmax(axis=1), unit_class[len(units.words) :])
    model = WordModel(table, kinds.sum(axis=0), group_class)
    known = spark.sparkContext.broadcast((words, counts, class_of, model.group_class, model.transition, model.divisor))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, class_of, group_class, transition, divisor = known.value
        end, leads = int(np.searchsorted(words, END.view(np.int64))), leading(words)
        for batch in batches:
            sums, sizes, found = np.zeros((4, len(batch))), np.zeros(len(batch), dtype=np.int64), []
            for row, hashes, group, offsets in tokens(batch.column("text")):
                at, here = places(words, hashes, leads)
                own, first = np.where(here, class_of[at], group_class[group]), offsets[:-1]
                before, here_before, word_before = np.r_[0, own[:-1]], np.r_[True, here[:-1]], np.r_[END, hashes[:-1]]
                before[first], here_before[first], word_before[first] = class_of[end], True, END
                base = np.where(here, np.log10(counts[at] + ADDED), 0.0)
                part = np.where(here, base - divisor[own], 0.0)
                part[here & here_before] += transition[before, own][here & here_before]
                for k, values in enumerate((np.ones(len(hashes)), here & (counts[at] > 0), base, part)):
                    sums[k, row : row + len(first)] = np.add.reduceat(values.astype(np.float64), first)
                # An end follows every rare word, at the latest; where the neighbour is rare too, the pair is told apart.
                sizes[row : row + len(first)] = np.add.reduceat((~here).astype(np.int64), first)
                here_after, after = np.r_[here[1:], True], np.r_[own[1:], 0]
                columns = (
                    hashes.view(np.int64), own, np.where(here_before, before, -1), np.where(here_after, after, -1),
                    np.where(here_before, 0, word_before.view(np.int64)), before,
                )
                found.append([x[~here] for x in columns])
            columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 6
            columns = [pa.array(x if k in (0, 4) else x.astype(np.int32)) for k, x in enumerate(columns)]
            rows = pa.StructArray.from_arrays(columns, names=["word", "own", "before", "after", "a", "ac"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                 pa.array(sums[2]), pa.array(sums[3]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), rows)],
                names=["doc_id", "held_out", "n_tokens", "n_resident", "base", "part", "rare"],
            )

    one = "struct<word: long, own: int, before: int, after: int, a: long, ac: int>"
    kinds = f"doc_id long, held_out boolean, n_tokens long, n_resident long, base double, part double, rare array<{one}>"
    held_out = ~is_training(F.col("doc_id"))
    scored = read.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(score, kinds)
    scored = save_shared(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    open_ = scored.select("row", F.inline("rare"))

    def looked_up(df: DataFrame, word: str, own: str, n: str) -> DataFrame:
        """Class and count of a word that no task holds; an unseen one keeps the class of its ending."""
        there = rare.select(F.col("word").alias(word), F.col("class").alias("_class"), F.col("n").alias(n))
        joined = df.join(there, word, "left").withColumn(own, F.coalesce("_class", own)).withColumn(n, F.coalesce(n, F.lit(0)))
        return joined.drop("_class")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, divisor = known.value[4:]
        for batch in batches:
            own, before, after, n = (batch.column(c).to_numpy() for c in ("own", "before", "after", "n"))
            base = np.where(n >= 0, np.log10(np.maximum(n, 0) + ADDED), 0.0)  # of a pair of rare words only the step counts
            part = np.where(n >= 0, base - divisor[own], 0.0)
            for known_, step in ((before >= 0, transition[before, own]), (after >= 0, transition[own, after])):
                part[known_] += step[known_]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array((n > 0).astype(np.int64)), pa.array(base), pa.array(part)],
                names=["row", "known", "rare_base", "rare_part"],
            )

    columns = ["row", "own", "before", "after", "n"]
    alone = looked_up(open_, "word", "own", "n").select(*columns)
    pairs = looked_up(looked_up(open_.where("before < 0"), "word", "own", "m"), "a", "ac", "k")
    pairs = pairs.select("row", "own", F.col("ac").alias("before"), F.lit(-1).alias("after"), F.lit(-1).cast("long").alias("n"))
    added = alone.unionByName(pairs).mapInArrow(add, "row long, known long, rare_base double, rare_part double")
    open_sums = added.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "rare_base", "rare_part")))
    joined = scored.drop("rare").join(open_sums, "row", "left")
    n_rare, rare_base, rare_part = (F.coalesce(c, F.lit(0)) for c in ("known", "rare_base", "rare_part"))
    base = F.col("base") + rare_base - F.col("n_tokens") * F.log10(F.lit(float(total) + ADDED * (distinct + 1)))
    full = F.col("part") + rare_part
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_resident") + n_rare).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"),
        F.pow(F.lit(10.0), -full / F.col("n_tokens")).alias("perplexity"),
    )
