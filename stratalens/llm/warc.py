"""WARC archives: pages to gzip-per-record files, and a reader that splits them anywhere."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm import files
from stratalens.session import save_shared, shared_path

#: Parameters of the registered query: least size of a payload that is stored once, and bytes of a reader's split.
LEAST_REVISIT = 0
SPLIT_BYTES = 16 << 20
#: Compression level of a record, bytes decoded at a time, and payload bytes of a batch.
LEVEL = 6
PIECE = 8 << 10
BATCH_BYTES = 4 << 20

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "path string, offset long, stored_bytes long, warc_type string, record_id string, target_uri string, "
    "headers map<string,string>, payload_bytes long, payload_digest string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda found: f"%{ord(found[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None = None) -> bytes:
    """One gzip member: a response, or a revisit of page ``first`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url) if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if first is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first), "X-Refers-To-Page-ID": str(first)}
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); the manifest: path, length, records.

    Of rows with equal payloads of at least ``least_revisit`` bytes, that with
    the smallest page_id is a response and the others revisit it. Only payloads
    that occur more than once are joined back, by digest; a payload of a third
    of all pages is split by the adaptive skew join. Every task writes one file;
    files of lost or repeated attempts are not in the manifest.

    A NULL html is the empty payload, a NULL url gives a target of its own.
    Rows that repeat the smallest id are responses all; rows without id revisit
    a page that has one, and are responses where no equal page has.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digested = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"))
    repeated = (
        digested.where(F.col("bytes") >= least_revisit)
        .groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("sha1", "first")
    )
    repeated = save_shared(repeated, "repeated-payloads")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    known = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    placed = keyed.join(repeated, "sha1", "left").select("page_id", "url", "payload", known.alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n = None, 0
        for batch in batches:
            if batch.num_rows and out is None:
                target = files.task_file(folder, TaskContext.get().partitionId(), ".warc.gz")
                system, path = files.located(target)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            for row in zip(*(batch.column(name) for name in ("page_id", "url", "payload", "first"))):
                out.write(record(*(value.as_py() for value in row)))
                n += 1
        if out is not None:
            length = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [target], "length": pa.array([length], pa.int64()), "records": pa.array([n], pa.int64())})

    return save_shared(placed.mapInArrow(write, "path string, length long, records long"), "warc-manifest")


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files of a folder or pattern, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


class _Bytes:
    """A growing view of a file from one place on; bytes before ``keep`` are forgotten."""

    def __init__(self, file, at: int, size: int, step: int = 1 << 20):
        self.file, self.base, self.size, self.step, self.held = file, at, size, step, b""

    def read(self, at: int, length: int, keep: int) -> bytes:
        while at + length > self.base + len(self.held) and self.base + len(self.held) < self.size:
            self.held += self.file.read_at(min(self.step, self.size - self.base - len(self.held)), self.base + len(self.held))
        if keep - self.base > self.step:
            self.held, self.base = self.held[keep - self.base :], keep
        return self.held[at - self.base : at - self.base + length]


def _member(data: _Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at ``at``; None if there is none.

    The first piece must decode to a WARC version line, the whole to headers
    and as many bytes as they promise.
    """
    decoder, parts, end = zlib.decompressobj(31), [], at
    try:
        while not decoder.eof:
            piece = data.read(end, PIECE, at)
            if not piece:
                return None
            parts.append(decoder.decompress(piece))
            end += len(piece)
            if len(parts) == 1 and not (parts[0] or VERSION).startswith(VERSION):
                return None
    except zlib.error:
        return None
    head, _, block = b"".join(parts).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = headers.get("Content-Length", "")
    if not lines[0].startswith(VERSION.decode()) or not length.isdigit() or len(block) < int(length):
        return None
    return headers, block[: int(length)], end - len(decoder.unused_data)


def records_of(file, start: int, end: int, size: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, stored bytes, headers and block of the records that start in the byte range.

    The range is searched for gzip magic up to the first member that decodes
    to a record; from there on, each record says where the next one starts. A
    place that only looks like a member, or a damaged one, is passed over by
    searching on.
    """
    data, at = _Bytes(file, start, size), start
    while at < end:
        found = _member(data, at) if data.read(at, 3, at) == MAGIC else None
        if found:
            headers, block, after = found
            yield at, after - at, headers, block
            at = after
            continue
        at += 1
        while at < end:
            ahead = data.read(at, PIECE, at)
            place = ahead.find(MAGIC)
            if place >= 0:
                at += place
                break
            at += max(len(ahead) - 2, 1)


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, length): place, type, ids, headers, payload, its size and its digest.

    Files are cut into ranges of ``split_bytes``, each a task, so one large
    archive is read by many; a record belongs to the range in which it starts.
    Of HTTP blocks the payload is the body; a revisit has none, its size and
    digest are those that the headers state. The digest is bare base32 SHA-1. No
    archives or an empty one give no rows.
    """
    listed = archives.select("path", "length").collect()  # one row per file, as any file listing
    ranges = [(row["path"], at, min(at + split_bytes, row["length"]), row["length"])
              for row in listed for at in range(0, row["length"], split_bytes)]
    schema = RECORD + (", payload binary" if payload else "")
    if not ranges:
        return spark.createDataFrame([], schema)
    splits = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "split int, path string, start long, end long, size long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RECORD.split(", ")] + ["payload"] * payload
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                 pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for split in batch.to_pylist():
                system, path = files.located(split["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for row in records_of(file, split["start"], split["end"], split["size"]):
                        rows.append(_fields(split["path"], *row)[: len(names)])
                        held += len(row[3])
                        if held > BATCH_BYTES or len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return splits.repartitionById(len(ranges), F.col("split")).mapInArrow(read, schema)


def _fields(path: str, offset: int, stored: int, headers: dict[str, str], block: bytes) -> tuple:
    kind, payload, size = headers.get("WARC-Type"), block, len(block)
    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if headers.get("Content-Type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(length[1]) if kind == "revisit" and length else len(payload)
    digest = stated if kind == "revisit" else digest_of(payload)
    if kind == "response" and stated and stated != digest:
        raise ValueError(f"payload differs from its digest: {path} at {offset}")
    return (path, offset, stored, kind, headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), list(headers.items()),
            size, digest, payload)


def archived(pages: DataFrame, split_bytes: int = SPLIT_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Every page written to archives below the shared folder and read back: its id and the record's fields."""
    spark = pages.sparkSession
    written = write_warc(pages, shared_path(spark, "warc"), least_revisit)
    found = read_warc(spark, written, split_bytes, payload=False)
    return found.withColumn("page_id", F.col("headers")["X-Page-ID"].cast("long")).withColumn(
        "refers_to", F.col("headers")["X-Refers-To-Page-ID"].cast("long")
    )
