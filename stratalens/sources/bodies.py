"""Binary bodies (images, pages) of any length in few large files, as a Spark data source.

A container file holds records one after the other: length of the key,
length of the body (-1 for NULL), key, body. An index beside the files names
the blocks, some MB of whole records each, that a committed write has made;
readers take byte ranges from it, so files of lost attempts are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "bodies"
MAGIC = b"BODIES01"
HEAD = "<Iq"
COLUMNS = {"key": "string", "length": "long", "part": "int", "body": "binary"}
#: Defaults of the options: size of a file, of a block, of a read partition, and of one row's piece of a body.
SIZES = {"fileBytes": 512 << 20, "blockBytes": 16 << 20, "partitionBytes": 64 << 20, "partBytes": 64 << 20}
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Blocks(WriterCommitMessage):
    """file, first byte, end and number of records of every block a task has written."""

    listed: list[tuple[str, int, int, int]]


@dataclass
class Ranges(InputPartition):
    listed: list[tuple[str, int, int, int]]


class BodiesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sizes: dict[str, int], columns: list[str]):
        self.path, self.sizes, self.columns = path, sizes, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Blocks:
        system, folder = _located(self.path)
        system.create_dir(folder, recursive=True)
        listed, out, name, start, rows = [], None, "", 0, 0

        def close_block() -> None:
            nonlocal start, rows
            if rows:
                listed.append((name, start, out.tell(), rows))
            start, rows = out.tell(), 0

        for batch in iterator:
            keys, bodies = batch.column(self.columns.index("key")), batch.column(self.columns.index("body"))
            for key, body in zip(keys, bodies.cast(pa.large_binary())):
                if out is None:
                    name = f"{uuid.uuid4().hex}.{FORMAT}"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(MAGIC)
                    start = out.tell()
                text, data = (key.as_py() or "").encode(), body.as_buffer()
                out.write(struct.pack(HEAD, len(text), -1 if data is None else data.size) + text)
                if data is not None:
                    out.write(data)
                rows += 1
                if out.tell() - start >= self.sizes["blockBytes"]:
                    close_block()
                if out.tell() >= self.sizes["fileBytes"]:
                    close_block()
                    out.close()
                    out = None
        if out is not None:
            close_block()
            out.close()
        return Blocks(listed)

    def commit(self, messages: list[Blocks | None]) -> None:
        """One index file a write, with one line per block: a reader sees all of the write or nothing."""
        system, folder = _located(self.path)
        system.create_dir(f"{folder}/_index", recursive=True)
        hidden, shown = (f"{folder}/_index/{mark}{uuid.uuid4().hex}.json" for mark in ("_", ""))
        with system.open_output_stream(hidden, compression=None) as out:
            for message in messages:
                for block in message.listed if message else ():
                    out.write((json.dumps(block) + "\n").encode())
        system.move(hidden, shown)

    def abort(self, messages: list[Blocks | None]) -> None:
        """Files that no index names are never read."""


class BodiesReader(DataSourceReader):
    def __init__(self, path: str, sizes: dict[str, int], columns: list[str]):
        self.path, self.sizes, self.columns = path, sizes, columns

    def partitions(self) -> Sequence[Ranges]:
        system, folder = _located(self.path)
        blocks = []
        for info in system.get_file_info(pafs.FileSelector(f"{folder}/_index")):
            if info.is_file and not info.base_name.startswith("_"):
                with system.open_input_stream(info.path, compression=None) as file:
                    blocks += [tuple(json.loads(line)) for line in file.read().decode().splitlines()]
        found, size = [], 0
        for block in sorted(blocks):
            if not found or size + block[2] - block[1] > self.sizes["partitionBytes"]:
                found.append(Ranges([]))
                size = 0
            found[-1].listed.append(block)
            size += block[2] - block[1]
        return found or [Ranges([])]

    def _records(self, file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[str, int | None, int, bytes | None]]:
        """Key, length, part and piece of every body in a range; without ``body`` among the columns bodies are skipped."""
        file.seek(start)
        while file.tell() < end:
            n, length = struct.unpack(HEAD, file.read(struct.calcsize(HEAD)))
            key = file.read(n).decode()
            if length <= 0 or "body" not in self.columns:
                yield key, None if length < 0 else length, 0, b"" if length == 0 else None
                file.seek(file.tell() + max(length, 0))
                continue
            for part in range(-(-length // self.sizes["partBytes"])):
                yield key, length, part, file.read(min(self.sizes["partBytes"], length - part * self.sizes["partBytes"]))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, folder = _located(self.path)
        kinds = {"key": pa.string(), "length": pa.int64(), "part": pa.int32(), "body": pa.binary()}
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            values = dict(zip(kinds, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(values[c], kinds[c]) for c in self.columns], names=self.columns)

        for name, start, end, _ in partition.listed:
            with system.open_input_file(f"{folder}/{name}") as file:
                for record in self._records(file, start, end):
                    held.append(record)
                    size += len(record[3] or b"")
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class BodiesSource(DataSource):
    """``spark.read.format("bodies")``; a schema of fewer columns reads fewer bytes. Paths are those that Arrow can open."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())

    def _sizes(self) -> dict[str, int]:
        return {name: int(self.options.get(name, size)) for name, size in SIZES.items()}

    def reader(self, schema) -> BodiesReader:
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return BodiesReader(self.options["path"], self._sizes(), schema.names)

    def writer(self, schema, overwrite: bool) -> BodiesWriter:
        if overwrite:
            raise ValueError("bodies are appended; write to a new path instead")
        return BodiesWriter(self.options["path"], self._sizes(), schema.names)


def write_bodies(bodies: DataFrame, path: str, **sizes: int) -> None:
    """Append ``bodies`` (key, body) to the container at ``path``. Any key is stored as text, NULL as the empty one."""
    bodies.sparkSession.dataSource.register(BodiesSource)
    chosen = bodies.select(bodies["key"].cast("string").alias("key"), bodies["body"].cast("binary").alias("body"))
    chosen.write.format(FORMAT).mode("append").options(**sizes).save(path)


def read_bodies(spark: SparkSession, path: str, columns: Sequence[str] = tuple(COLUMNS), **sizes: int) -> DataFrame:
    """``columns`` of all stored bodies: key, length (NULL of a NULL body), part, body.

    A body longer than ``partBytes`` comes in several rows, ``part`` counting
    from 0 (``length`` is that of the whole). Without ``body`` only keys and
    lengths are read, one row per body.
    """
    spark.dataSource.register(BodiesSource)
    schema = ", ".join(f"{name} {COLUMNS[name]}" for name in columns)
    return spark.read.format(FORMAT).schema(schema).options(**sizes).load(path)
