"""Overlap of two token lists: the per-row helpers behind the caption metrics."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ORDERS = (1, 2, 3, 4)


def _codes(values: pa.Array | np.ndarray) -> np.ndarray:
    """Small integers that are equal where the values are."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def _own_ngrams(code: np.ndarray, text: np.ndarray):
    """For each order: where the n-grams begin, and a code per n-gram. None crosses a text's end."""
    at, gram = np.arange(len(code)), code
    width = int(code.max(initial=0)) + 1
    for n in ORDERS:
        if n > 1:
            inside = at + n - 1 < len(code)
            at, gram = at[inside], gram[inside]
            inside = text[at] == text[at + n - 1]
            at, gram = at[inside], gram[inside]
            gram = _codes(gram * width + code[at + n - 1])
        yield at, gram


def clip_counts(predicted: pa.Array, references: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """n-gram matches per sample and order, prediction lengths, reference lengths per sample.

    Texts are tokens joined by spaces. An n-gram of the prediction counts at
    most as often as it occurs in one of the sample's references.
    """
    n_samples = len(predicted)
    n_refs = references.value_lengths().fill_null(0).to_numpy()
    owner = np.concatenate([np.arange(n_samples), np.repeat(np.arange(n_samples), n_refs)])
    first = np.cumsum(n_refs) - n_refs
    side = np.concatenate([np.zeros(n_samples, int), 1 + np.arange(n_refs.sum()) - np.repeat(first, n_refs)])
    split = pc.split_pattern(pa.concat_arrays([predicted, references.flatten()]), " ")
    flat = split.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(owner)), split.value_lengths().to_numpy())[filled]
    lengths = np.bincount(text, minlength=len(owner))
    sides = int(side.max(initial=0)) + 1
    matches = np.zeros((n_samples, len(ORDERS)), np.int64)
    for n, (at, gram) in zip(ORDERS, _own_ngrams(_codes(flat)[filled], text)):
        sample = owner[text[at]]
        entry = _codes(sample * (int(gram.max(initial=0)) + 1) + gram)
        n_entries = int(entry.max(initial=-1)) + 1
        counts = np.bincount(entry * sides + side[text[at]], minlength=n_entries * sides).reshape(-1, sides)
        clipped = np.minimum(counts[:, 0], counts[:, 1:].max(axis=1, initial=0))
        of_entry = np.zeros(n_entries, np.int64)
        of_entry[entry] = sample
        matches[:, n - 1] = np.bincount(of_entry, weights=clipped, minlength=n_samples)
    return matches, lengths[:n_samples], np.split(lengths[n_samples:], np.cumsum(n_refs)[:-1])


def reference_length(predicted: int, references: Iterable[int], rule: str = "closest") -> int:
    """Length of the closest reference (the shorter one on ties), or of the shortest."""
    if rule == "shortest":
        return min(references, default=0)
    return min(references, key=lambda r: (abs(r - predicted), r), default=0)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one big-integer row per token of ``b``."""
    where: dict[str, int] = defaultdict(int)
    for i, token in enumerate(a):
        where[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hits = row & where.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def rouge_l_f1(predicted: list[str], reference: list[str]) -> float:
    length = len(predicted) + len(reference)
    return 2 * lcs_length(predicted, reference) / length if length else 0.0


def _occurrence(key: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    found = np.empty(len(key), np.int64)
    found[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    return found


def equal_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in (owner, class) of both sides where the k-th of a class on the left meets the k-th on the right."""
    owner, kind = (np.concatenate(both).astype(np.int64) for both in zip(left, right))
    key = np.unique(owner * (int(kind.max(initial=0)) + 1) + kind, return_inverse=True)[1]
    sides = key[: len(left[0])], key[len(left[0]) :]
    ranks = [_occurrence(side) for side in sides]
    width = max(int(rank.max(initial=0)) for rank in ranks) + 1
    own = [side * width + rank for side, rank in zip(sides, ranks)]
    return np.intersect1d(*own, assume_unique=True, return_indices=True)[1:]


def synset_pairs(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], synsets: list[list[int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Left to right, each word takes the first free word of its owner that shares a synset; classes are word codes."""
    if max(map(len, synsets), default=0) < 2:  # sharing is an equivalence then
        of_word = np.array([own[0] if own else -1 for own in synsets], dtype=np.int64)
        sides = [(owner, of_word[code], np.flatnonzero(of_word[code] >= 0)) for owner, code in (left, right)]
        found = equal_pairs(*((owner[at], kind[at]) for owner, kind, at in sides))
        return sides[0][2][found[0]], sides[1][2][found[1]]
    free: dict[tuple[int, int], deque[int]] = defaultdict(deque)
    for at, (owner, code) in enumerate(zip(right[0].tolist(), right[1].tolist())):
        for synset in synsets[code]:
            free[owner, synset].append(at)
    used, pairs = set(), []
    for at, (owner, code) in enumerate(zip(left[0].tolist(), left[1].tolist())):
        firsts = []
        for synset in synsets[code]:
            queue = free.get((owner, synset), ())
            while queue and queue[0] in used:
                queue.popleft()
            firsts += [queue[0]] if queue else []
        if firsts:
            used.add(min(firsts))
            pairs.append((at, min(firsts)))
    return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)


Lists = tuple[np.ndarray, np.ndarray]


def meteor(predicted: Lists, reference: Lists, stems: np.ndarray | None = None, synsets: list[list[int]] | None = None) -> np.ndarray:
    """METEOR of every pair of texts, given as word codes and the number of words of each text.

    Equal words are matched first, then those with equal ``stems`` (by word
    code), then those that share one of ``synsets``; each stage takes what the
    ones before left, from left to right.
    """
    sides = [(np.repeat(np.arange(len(counts)), counts), codes) for codes, counts in (predicted, reference)]
    free = [np.arange(len(codes)) for _, codes in sides]
    stages = [equal_pairs]
    if stems is not None:
        stages.append(lambda left, right: equal_pairs((left[0], stems[left[1]]), (right[0], stems[right[1]])))
    if synsets is not None:
        stages.append(lambda left, right: synset_pairs(left, right, synsets))
    matched = []
    for stage in stages:
        pairs = stage(*((owner[at], codes[at]) for (owner, codes), at in zip(sides, free)))
        matched.append([at[own] for at, own in zip(free, pairs)])
        free = [np.delete(at, own) for at, own in zip(free, pairs)]
    at, to = (np.concatenate(own) for own in zip(*matched))
    order = np.argsort(at)
    at, to = at[order], to[order]
    owner = sides[0][0][at]
    goes_on = (np.diff(owner) == 0) & (np.diff(at) == 1) & (np.diff(to) == 1)
    n = len(predicted[1])
    matches = np.bincount(owner, minlength=n).astype(float)
    chunks = np.bincount(owner[np.r_[True, ~goes_on]] if len(at) else owner, minlength=n)
    any_ = np.maximum(matches, 1)
    precision, recall = any_ / np.maximum(predicted[1], 1), any_ / np.maximum(reference[1], 1)
    score = 10 * precision * recall / (recall + 9 * precision) * (1 - 0.5 * (chunks / any_) ** 3)
    return np.where(matches > 0, score, 0.0)
