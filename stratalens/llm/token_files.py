"""Token ids in raw shard files with a minimal perfect hash index for access by document."""

from __future__ import annotations

import io
import json
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.llm import files, perfect_hash, words
from stratalens.session import save_shared, shared_path

#: Parameters of the registered query. The end id closes every document.
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Bounds of a worker's memory: units whose ids are remembered (some 20 bytes each), and new units encoded at once.
REMEMBERED = 1 << 20
NEW_UNITS = 10_000
MAGIC = b"TOKENS01"
NO_ID = -(2**63)


#: White space of one byte, and lead bytes under which Unicode has white space.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_MAY_BE_BLANK = _BLANK.astype(np.int32)
_MAY_BE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = 1


def _separators(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of spaces and line feeds that stand alone between two other characters of a text (``starts``: first bytes)."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = edge[len(data)] = True
    at = at[~edge[at] & ~edge[at + 1]]
    wide = np.r_[np.zeros(3, np.uint8), data, np.zeros(2, np.uint8)]
    before, after = wide[at + 2], wide[at + 4]
    # Lead bytes under which Unicode has white space; some of what they lead is none, which only makes a unit longer.
    leads = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380)
    last, first, following = (wide[at + k].astype(np.int64) << 8 | wide[at + k + 1] for k in (1, 0, 4))
    odd = np.isin(last, leads[:2]) | np.isin(first, leads[2:]) | np.isin(following, leads)
    return at[~(_BLANK[before] | _BLANK[after] | odd)]


class Encoder:
    """Whole texts to ids by a byte-level BPE tokenizer, encoding each distinct unit once.

    The tokenizer splits texts before it merges: a single space between two
    other characters begins a piece, a single line feed is a piece. So texts
    are cut there into units (a space belongs to the unit after it), units are
    looked up by a 64-bit hash in sorted arrays, and only new ones become
    strings for the library. Other white space stays inside a unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            held = json.load(file)
        pre = held["pre_tokenizer"]
        self.by_unit = (
            pre is not None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not held["normalizer"]
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in held["added_tokens"])
        )
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)
        line = self._encode(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One per Python worker, kept for its later tasks."""
        held = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
        return held.get(path) or held.setdefault(path, cls(path))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.kind) for x in found]

    def _encode_lines(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has, for units in which no line feed can merge or hide.

        They are encoded as one text of as many lines; the id of the line feed
        tells them apart.
        """
        found, counts = [np.zeros(0, self.kind)], []
        for at in range(0, len(units), NEW_UNITS):
            ids = self._encode([b"\n".join(units[at : at + NEW_UNITS]).decode()])[0]
            line = ids == self.line
            found.append(ids[~line])
            counts.append(np.diff(np.r_[-1, np.flatnonzero(line), len(ids)]) - 1)
        return np.concatenate(found), np.concatenate([np.zeros(0, np.int64), *counts])

    def _encode_units(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units of ``order`` one after the other, how many each has, and ``order``: plain ones first."""
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        n = int(plain.sum())
        ids, counts = self._encode_lines([units[i] for i in order[:n].tolist()])
        others = self._encode([units[i].decode() for i in order[n:].tolist()])
        return np.concatenate([ids, *others]), np.r_[counts, [len(own) for own in others]].astype(np.int64), order

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; NULL is the empty text."""
        if not self.by_unit:
            for at in range(0, len(texts), 16):
                yield from self._encode(texts.slice(at, 16).fill_null("").to_pylist())
            return
        for _, data, offsets in words.steps(texts):
            if len(offsets) == 2 and len(data) > 2 * words.STEP_BYTES:
                yield np.concatenate([self._step(piece, np.array([0, len(piece)]))[0] for piece in self._cut(data)])
            else:
                yield from self._step(data, offsets)

    def _cut(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in pieces of one step at least, which end where a unit ends."""
        at = 0
        while at < len(data):
            end, reach = len(data), 4096
            while at + words.STEP_BYTES + reach < len(data):  # look for a separator behind one step
                near = at + words.STEP_BYTES - 3
                found = _separators(data[near : near + reach], np.zeros(0, np.int64))
                found = found[found >= 3]  # what stands before an earlier one is not in view
                if len(found):
                    end = near + int(found[0])
                    break
                reach *= 2
            yield data[at:end]
            at = end

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [self.ids[:0]] * (len(offsets) - 1)
        at = _separators(data, offsets[:-1][offsets[:-1] < len(data)])
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = begins[at] = begins[at[data[at] == 0x0A] + 1] = True
        cuts = np.flatnonzero(begins[:-1])
        sizes = np.diff(np.r_[cuts, len(data)])
        unit, first, code = np.unique(words.slice_hashes(data, cuts, sizes), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unit)
        known = np.r_[self.hashes, np.uint64(0)][place] == unit
        known &= place < len(self.hashes)
        starts, counts = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        starts[known], counts[known] = self.starts[place[known]], self.sizes[place[known]]
        new = np.flatnonzero(~known)
        flat = self.ids
        if len(new):
            text = data.tobytes()
            blanks = np.add.reduceat(_MAY_BE_BLANK[data], cuts)[first[new]]
            lead = data[cuts[first[new]]] == 0x20
            plain = (blanks == lead) & (sizes[first[new]] > lead) & (self.line is not None)
            own = [text[a:b] for a, b in zip(cuts[first[new]].tolist(), (cuts + sizes)[first[new]].tolist())]
            ids, n, order = self._encode_units(own, plain)
            new = new[order]
            counts[new], starts[new] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, ids])
            if len(self.hashes) + len(new) <= REMEMBERED:
                new = np.sort(new)
                self.ids = flat
                self.starts = np.insert(self.starts, place[new], starts[new])
                self.sizes = np.insert(self.sizes, place[new], counts[new])
                self.hashes = np.insert(self.hashes, place[new], unit[new])
        count = counts[code]
        ends = np.cumsum(count)
        joined = flat[np.arange(ends[-1]) + np.repeat(starts[code] - (ends - count), count)]
        bounds = np.r_[0, ends][np.searchsorted(cuts, offsets)]
        return [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def token_count(text: Column, tokenizer: str, keep: bool = True) -> Column:
    """How many ids each whole text has, without an end id; NULL has none.

    A worker keeps the encoder for its later tasks; without ``keep`` each task
    has one of its own, which costs time and leaves no memory behind.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.of_process(tokenizer) if keep else Encoder(tokenizer)
        for texts in batches:
            yield pa.array([len(ids) for ids in encoder.encode(texts)], pa.int64())

    return count(text)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files in ascending doc_id order; the manifest, one row per shard.

    A shard is a range of doc_id: a payload file (``TOKENS01``, the bytes of
    an id as one byte, then all ids, little-endian) and an index file (NumPy
    ``npz``): the levels of a minimal perfect hash of the documents, and at
    each document's slot its fingerprint, first id and number of ids. Ids take
    two bytes where the vocabulary allows. Files of lost or repeated attempts
    are not in the manifest: shard, payload, index, last_id, n_docs, n_tokens, start.

    A NULL text is the empty text: its document is the end id alone. Rows that
    repeat an id follow each other by text; NULL ids come first.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, counts, ids = TaskContext.get().partitionId(), None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = Encoder.of_process(tokenizer)
                payload, index = (files.task_file(folder, part, s) for s in (".tokens", ".npz"))
                system, path = files.located(payload)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out, end = system.open_output_stream(path, compression=None), np.array([end_id], dtype=encoder.kind).tobytes()
                out.write(MAGIC + bytes([encoder.kind.itemsize]))
            ids.append(batch.column("doc_id"))
            for own in encoder.encode(batch.column("text")):
                counts.append(len(own) + 1)
                out.write(own.tobytes() + end)
        if out is None:
            return
        out.close()
        ids, n_tokens = pa.chunked_array(ids), np.array(counts, dtype=np.int64)
        keys = perfect_hash.document_keys(*_occurrences(ids))
        held = perfect_hash.build(keys)
        slot = perfect_hash.slots(held, keys)
        table = {"fingerprint": perfect_hash.fingerprints(keys), "first": np.cumsum(n_tokens) - n_tokens, "n": n_tokens}
        for name, values in table.items():
            held[name] = np.empty_like(values)
            held[name][slot] = values
        data = io.BytesIO()
        np.savez(data, **held)
        system, path = files.located(index)
        with system.open_output_stream(path, compression=None) as stream:
            stream.write(data.getvalue())
        last = pc.max(ids).as_py()
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([part], pa.int32()), "payload": [payload], "index": [index],
            "last_id": pa.array([NO_ID if last is None else last], pa.int64()),
            "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([n_tokens.sum()], pa.int64()),
        })

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(write, "shard int, payload string, index string, last_id long, n_docs long, n_tokens long")
    shards = save_shared(shards, "token-shards")
    # One row per shard stands in this window.
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _occurrences(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are missing, and how many equal ones stand before; equal ids must be adjacent."""
    missing = np.asarray(pc.is_null(ids))
    values = np.asarray(ids.fill_null(0))
    same = np.r_[False, (values[1:] == values[:-1]) & (missing[1:] == missing[:-1])] if len(values) else missing
    row = np.arange(len(values))
    return values, missing, row - np.maximum.accumulate(np.where(same, 0, row))


def read_tokens(manifest: DataFrame, keys: DataFrame, digest: bool = True) -> DataFrame:
    """The stored documents of ``keys`` (doc_id), by way of the index: doc_id, start, n_tokens, and ids_crc32 or ids.

    A key's shard follows from the shards' last ids, its place in the shard
    from the perfect hash; a key whose fingerprint differs was never written
    and gives no row. Every shard is one task, which reads its index once and
    the asked-for parts of the payload in order. A key given twice stands for
    the first and the second document with that id. ``ids_crc32`` is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    shards = manifest.orderBy("shard").collect()  # one row per shard
    last = np.array([row["last_id"] for row in shards], dtype=np.int64)
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    if not shards:
        return manifest.sparkSession.createDataFrame([], schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            shard = np.searchsorted(last, np.asarray(ids.fill_null(NO_ID)))
            shard = np.where(shard < len(last), shard, 0).astype(np.int32)  # beyond all: the fingerprint will tell
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard)], names=["doc_id", "_shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        asked = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
        ids, shard = asked.column("doc_id"), shards[asked.column("_shard")[0].as_py()]
        system, path = files.located(shard["index"])
        with system.open_input_file(path) as file:
            index = dict(np.load(io.BytesIO(file.read())))
        keys = perfect_hash.document_keys(*_occurrences(ids))
        slot = perfect_hash.slots(index, keys)
        known = (slot >= 0) & (index["fingerprint"][slot] == perfect_hash.fingerprints(keys))
        row, slot = np.flatnonzero(known), slot[known]
        order = np.argsort(index["first"][slot], kind="stable")
        row, first, n = row[order], index["first"][slot][order], index["n"][slot][order]
        system, path = files.located(shard["payload"])
        with system.open_input_file(path) as file:
            window = files.Window(file, file.size())
            head = bytes(window.read(0, len(MAGIC) + 1))
            if head[:-1] != MAGIC:
                raise ValueError(f"not a token file: {path}")
            kind = np.dtype(f"<u{head[-1]}")
            for at in range(0, len(row), 1000):
                part = slice(at, at + 1000)
                found = [np.frombuffer(window.read(len(head) + a * kind.itemsize, b * kind.itemsize), dtype=kind)
                         for a, b in zip(first[part].tolist(), n[part].tolist())]
                content = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()) if digest else pa.array(
                    [x.astype(np.int64) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[part])).combine_chunks(), pa.array(shard["start"] + first[part]), pa.array(n[part]), content],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    placed = keys.select("doc_id").mapInArrow(place, "doc_id long, _shard int")
    return placed.repartitionById(len(shards), F.col("_shard")).mapInArrow(read, schema)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every document written to token files below the shared folder and read back by its key."""
    manifest = save_shared(write_tokens(docs, shared_path(docs.sparkSession, "tokens"), tokenizer), "token-manifest")
    return read_tokens(manifest, docs.select("doc_id"))
