"""Angular distance, as a Column for single pairs and as an Arrow kernel for all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

COSINE_FLOOR = 1e-8  # fixed value: smallest product of norms


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def angular_distance(a: Column, b: Column) -> Column:
    """acos of the cosine over pi, in 0..1; a zero vector gives 0.5."""
    cosine = _dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(COSINE_FLOOR))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()


def stacked_layers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Packed layers of a batch as [sample, layer, dim] and a presence mask."""
    states = column.flatten()
    present = states.is_valid().to_numpy(zero_copy_only=False)
    flat = states.flatten().to_numpy(zero_copy_only=False)
    n_samples = len(column)
    n_layers = len(states) // max(n_samples, 1)
    dim = len(flat) // max(int(present.sum()), 1)
    lengths = states.value_lengths().drop_null()
    if len(lengths) and pa.compute.any(pa.compute.not_equal(lengths, dim)).as_py():
        raise ValueError("hidden states differ in dimension")
    cube = np.zeros((n_samples * n_layers, dim))
    cube[present] = flat.reshape(-1, dim)
    return cube.reshape(n_samples, n_layers, dim), present.reshape(n_samples, n_layers)


def _starts(columns: list[pa.ChunkedArray], rows: int) -> np.ndarray:
    """Where a new combination of keys begins in sorted columns."""
    new = np.zeros(rows, dtype=bool)
    new[:1] = True
    for column in columns:
        own, before = column.slice(1), column.slice(0, max(rows - 1, 0))
        differs = pc.or_kleene(pc.not_equal(own, before), pc.xor(pc.is_null(own), pc.is_null(before)))
        new[1:] |= pc.fill_null(differs, False).to_numpy()
    return np.flatnonzero(new)


def pack_kernel(n_layers: int):
    """A mapInArrow function over rows sorted by sample and layer: one row per sample with all its states."""

    def packed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sample = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
        layer = rows.column("layer").to_numpy()
        used = np.flatnonzero((layer >= 0) & (layer < n_layers))[::-1]  # of repeated layers the first one stays
        at = np.full(len(starts) * n_layers, -1, dtype=np.int64)
        at[sample[used] * n_layers + layer[used]] = used
        states = rows.column("v").combine_chunks().take(pa.array(at, mask=at < 0))
        offsets = np.arange(len(starts) + 1, dtype=np.int32) * n_layers
        samples = rows.column("sample_id").take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([samples, pa.ListArray.from_arrays(offsets, states)], names=["sample_id", "layers"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts([rows.column("sample_id")], rows.num_rows)
            last = int(starts[-1])  # the last sample may go on in the next batch
            if last:
                yield packed(rows.slice(0, last), starts[:-1])
            held = rows.slice(last)
        if held is not None:
            yield packed(held, np.zeros(1, dtype=np.int64))

    return pack


def last_positions_kernel(keys: list[str]):
    """A mapInArrow function: of each key in a batch the row with the highest ``pos``; NULL only without any."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                order = pc.sort_indices(table.drop(["v"]), [*((key, "ascending") for key in keys), ("pos", "descending")])
                narrow = table.select(keys).take(order)
                first = order.take(pa.array(_starts(narrow.columns, table.num_rows)))
                yield batch.take(first)

    return last


def pair_totals_kernel(n: int | None, group: str | None, slice_rows: int = 64):
    """A mapInArrow function: distances of every layer pair, summed per batch.

    Each Arrow batch yields at most one row per block (and group), so what
    reaches the shuffle does not depend on the number of samples.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(offset, slice_rows)
                cube, present = stacked_layers(batch.column("layers"))
                low, high = np.triu_indices(cube.shape[1], k=1)
                if n is not None:
                    chosen = high - low == n
                    low, high = low[chosen], high[chosen]
                norms = np.sqrt(np.einsum("sld,sld->sl", cube, cube))
                gram = cube @ cube.transpose(0, 2, 1)
                cosine = gram[:, low, high] / np.maximum(norms[:, low] * norms[:, high], COSINE_FLOOR)
                both = present[:, low] & present[:, high]
                distance = np.where(both, np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi, 0.0)
                if group is None:
                    keys, at = np.zeros(1, np.int64), np.zeros(batch.num_rows, np.int64)
                else:
                    keys, at = np.unique(batch.column(group).to_numpy(), return_inverse=True)
                total = np.zeros((len(keys), len(low)))
                pairs = np.zeros((len(keys), len(low)), np.int64)
                np.add.at(total, at, distance)
                np.add.at(pairs, at, both)
                used = pairs.ravel() > 0
                columns = {
                    "n": np.tile(high - low, len(keys)).astype(np.int32),
                    "block_start": np.tile(low + 1, len(keys)).astype(np.int32),
                    "total": total.ravel(),
                    "pairs": pairs.ravel(),
                }
                if group is not None:
                    columns = {group: np.repeat(keys, len(low)).astype(np.int64), **columns}
                yield pa.RecordBatch.from_pydict({name: pa.array(values[used]) for name, values in columns.items()})

    return totals
