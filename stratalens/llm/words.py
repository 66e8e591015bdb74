"""Words of whole texts as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken in one vector step, which needs some fifty times as much memory.
STEP_BYTES = 1 << 19
PLACES = 128

_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A random number for each byte at each place of a word (tabulation hashing).
_AT_PLACE = np.random.default_rng(7).integers(0, 2**64, (PLACES, 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers after which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets (from 0) of slices of a text column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        own = offsets[row : end + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, in order, the number of words in each row, and the words' last two bytes.

    A single long text is taken in pieces cut between words.
    """
    if len(offsets) > 2 or len(data) <= 2 * STEP_BYTES:
        return _word_hashes(data, offsets)
    found, at = [], 0
    while at < len(data):
        end = min(at + STEP_BYTES, len(data))
        if end < len(data):
            cuts = np.flatnonzero(_SEPARATES[data[at:end]])
            if len(cuts) and cuts[-1] > 0:
                end = at + int(cuts[-1])
            else:  # within one word longer than a step: go on to its end
                while end < len(data) and not _SEPARATES[data[end]]:
                    end += 1
        found.append(_word_hashes(data[at:end], np.array([0, end - at])))
        at = end
    hashes, counts, endings = zip(*found)
    return np.concatenate(hashes), np.sum(counts, axis=0), np.concatenate(endings)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SEPARATES[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    before = np.r_[False, inside[:-1]] & ~breaks[:-1] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    kept = np.flatnonzero(inside)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    firsts = np.searchsorted(kept, starts)
    lengths = np.diff(np.r_[firsts, len(kept)])
    place = np.arange(len(kept)) - np.repeat(firsts, lengths)
    values = _AT_PLACE[place % PLACES, _LOWER[data[kept]]]
    if lengths.max() > PLACES:
        values = values * (2 * (place // PLACES) + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    last = firsts + lengths - 1
    lower = _LOWER[data[kept[last]]].astype(np.int64)
    endings = lower + 256 * np.where(lengths > 1, _LOWER[data[kept[last - 1]]], 0).astype(np.int64)
    return hashes, np.diff(np.searchsorted(starts, offsets)), endings


def slice_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings that ``data`` falls into at ``starts`` (the first is 0, none is empty)."""
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    values = _AT_PLACE[place % PLACES, data]
    if lengths.max(initial=0) > PLACES:
        values = values * (2 * (place // PLACES) + 1).astype(np.uint64)
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


def texts_to_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, hashes of all words, and word offsets of its rows, for each slice of a text column."""
    for row, data, offsets in steps(column):
        hashes, counts, _ = word_hashes(data, offsets)
        yield row, hashes, np.r_[0, np.cumsum(counts)]


def shingle_sets(column: pa.Array, width: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of ``width`` words of each text; of fewer words, the whole sequence; of none, nothing."""
    for _, words, offsets in texts_to_words(column):
        for first, last in zip(offsets[:-1], offsets[1:]):
            own = words[first:last]
            if len(own):
                size = min(width, len(own))
                found = own[: len(own) - size + 1]
                for k in range(1, size):
                    found = mix(found * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - size + 1 + k])
                own = found
            yield np.unique(own)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a stream sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def key_at(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(name)[row].as_py() for name in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, dtype=bool)
        for name in keys:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            differs[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(differs)
        for first, end in zip(np.r_[0, starts], np.r_[starts, batch.num_rows]):
            own = key_at(batch, int(first))
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = own
    if held:
        yield pa.Table.from_batches(held)
