"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalens.session import save_shared

#: A paragraph is a line; a line of more code points is cut after sentence ends, and a sentence of more into such runs.
LONGEST = 120
#: On average so many paragraphs make a section.
PER_SECTION = 8
_PARTS = re.compile(rf"[^\n]{{0,{LONGEST - 2}}}?[.!?](?: |\n|$)|[^\n]{{1,{LONGEST - 1}}}\n?|\n")


def paragraphs(text: str) -> list[str]:
    """The text cut into paragraphs; joined they are the text."""
    found = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        found += [line] if len(line) <= LONGEST else _PARTS.findall(line)
    return found


def fingerprint(text: str) -> str:
    """``root/section:leaves/section:leaves...`` in hexadecimal digits.

    A leaf (8 digits) is a paragraph's hash. A section ends at an empty line or
    after a paragraph whose own hash says so, so an edit moves no boundary
    elsewhere; its hash (16 digits) covers its leaves. The root (32 digits)
    covers all sections: equal texts have equal roots, different texts do not.
    """
    sections, leaves = [], []
    for paragraph in paragraphs(text):
        leaf = hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        leaves.append(leaf)
        if paragraph == "\n" or leaf[-1] % PER_SECTION == 0:
            sections.append(leaves)
            leaves = []
    if leaves:
        sections.append(leaves)
    nodes = [hashlib.blake2b(b"".join(own), digest_size=16).digest() for own in sections]
    root = hashlib.blake2b(b"".join(nodes), digest_size=16, person=b"root").hexdigest()
    branches = (f"/{node.hex()[:16]}:{''.join(leaf.hex()[:8] for leaf in own)}" for node, own in zip(nodes, sections))
    return root + "".join(branches)


def branches(fingerprint: str) -> list[tuple[str, list[str]]]:
    """The sections of a fingerprint: hash and leaves."""
    found = []
    for part in fingerprint.split("/")[1:]:
        node, _, leaves = part.partition(":")
        found.append((node, [leaves[i : i + 8] for i in range(0, len(leaves), 8)]))
    return found


def likeness(a: str, b: str) -> float:
    """Shared leaves over all leaves of both trees (Dice, repeats counted); 1 for equal roots.

    Sections that both trees have are counted whole; only differing ones are opened.
    """
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    left, right = branches(a), branches(b)
    same = Counter(node for node, _ in left) & Counter(node for node, _ in right)
    total = sum(len(leaves) for _, leaves in left) + sum(len(leaves) for _, leaves in right)
    shared, rest = 0, []
    for side in (left, right):
        open_ = Counter(same)
        leaves: Counter[str] = Counter()
        for node, own in side:
            if open_[node] > 0:
                open_[node] -= 1
                shared += len(own)
            else:
                leaves.update(own)
        rest.append(leaves)
    shared += 2 * sum((rest[0] & rest[1]).values())
    return shared / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Section and paragraph numbers (from 0) in ``a`` of leaves that ``b`` lacks; equal branches are not opened."""
    if a.partition("/")[0] == b.partition("/")[0]:
        return []
    nodes = Counter(node for node, _ in branches(b))
    leaves = Counter(leaf for _, own in branches(b) for leaf in own)
    found = []
    for i, (node, own) in enumerate(branches(a)):
        if nodes[node] > 0:
            nodes[node] -= 1
            leaves.subtract(own)
            continue
        for j, leaf in enumerate(own):
            if leaves[leaf] > 0:
                leaves[leaf] -= 1
            else:
                found.append((i, j))
    return found


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _row(doc_id: int | None, text: str, own: str, following: str, other: str) -> tuple:
    changed = edited(text, following)
    of_changed = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, of_changed, likeness(own, of_changed), likeness(own, other)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likeness, with the next document by doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every row of ``docs`` (doc_id, text). Texts are
    shuffled once, by ranges of doc_id; a task reads its range in order and
    holds two texts at a time. The last document of a range waits for the first
    of the next one: such rows, one per task, are stored and completed by a join.

    A NULL text is the empty text. Rows that repeat an id follow each other by
    text; NULL ids come first. The only row of a table is followed by itself;
    an empty table gives an empty result. Other columns are not read.
    """
    stored = f"{FIELDS}, part int, is_first boolean, is_last boolean, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema, before, first = TaskContext.get().partitionId(), _schema(stored), None, True
        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                own = fingerprint(text)
                if before:
                    done.append((*_row(*before, text, own), part, first, False, before[1] if first else None))
                    first = False
                before = (doc_id, text, own)
                if len(done) == 500:
                    yield _batch(done, schema)
                    done = []
            yield _batch(done, schema)
        if before:
            doc_id, text, own = before
            yield _batch([(doc_id, len(text), None, own, None, None, None, part, first, True, text)], schema)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed = save_shared(ordered.mapInArrow(walk, stored), "fingerprints")
    heads = placed.where("is_first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # One narrow row per task stands in this window.
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = placed.where("is_first").select(
        F.col("part").alias("before"), F.coalesce(F.lead("part").over(whole), F.first("part").over(everything)).alias("part")
    )
    waiting = placed.where("is_last").select(F.col("part").alias("before"), "doc_id", "text", "fingerprint")
    waiting = waiting.join(follows, "before").join(heads, "part").drop("part", "before")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
            yield _batch([_row(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns))], _schema(FIELDS))

    last = waiting.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(complete, FIELDS)
    return placed.where("NOT is_last").select(*last.columns).unionByName(last)
