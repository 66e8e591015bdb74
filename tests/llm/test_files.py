"""WARC archives and token files: exact round trips."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from stratalens.llm import files, perfect_hash, token_files, warc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def pages():
    rows = [(i, f"https://e.example/{i}", f"<p>{'x' * (i * 7 % 50)}</p>") for i in range(200)]
    rows += [(900, None, None), (901, "u\r\nInjected: 1", ""), (902, "", "ä中\U0001F600" * 300), (903, "l", "long " * 100_000)]
    return rows + [rows[0], (None, "n", rows[1][2]), (None, "m", "only without id"), (None, "m", "only without id")]


def expected_pages(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        of = first.get(html or "")
        revisit = of is not None and of != page
        yield page, len(body), digest, "revisit" if revisit else "response", of if revisit else None


@pytest.mark.parametrize("split", [97, 4096, warc.SPLIT_BYTES])
def test_archive_round_trip(spark, split):
    rows = pages()
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, headers int").repartition(3)
    found = warc.archived(df, split)
    got = [tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(expected_pages(rows), key=str)
    assert found.where("warc_type = 'revisit' AND headers['WARC-Refers-To'] IS NULL").count() == 0


def test_payloads_below_the_least_size_are_all_stored(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    found = {r.page_id: (r.warc_type, r.refers_to) for r in warc.archived(df, least_revisit=5).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_reader_passes_over_what_only_looks_like_a_record(spark, tmp_path):
    good = [warc.record(i, "u", f"payload {i}".encode()) for i in range(3)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good[0] + b"\x1f\x8b\x08junk" + zlib.compress(b"x") + good[1] + good[2][: len(good[2]) // 2])
    listed = warc.list_warc(spark, str(tmp_path))
    for split in (1, 10, 10_000):
        found = warc.read_warc(spark, listed, split).orderBy("offset").collect()
        assert [bytes(r.payload) for r in found] == [b"payload 0", b"payload 1"]
        assert [r.offset for r in found][0] == 0 and found[0].stored_bytes == len(good[0])


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).collect() == []


TOKENIZER = public_tokenizers.path(token_files.TOKENIZER)
TEXTS = [
    "plain words, some. More words", "", None, " leading", "trailing ", "two  spaces", "a \n b", "tab\tand \t tab", "x y   z",
    "end <|endoftext|> inside<|endoftext|>", "don't we'll it's 12 345 a1b2", "\U0001F600 é中文 café", "\n\n", "   ", "a\r\n b",
    "word " * 5000 + "last", "  　 x", "plain words, some. More words",
]


def test_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    found = list(token_files.Encoder(TOKENIZER).encode(pa.array(TEXTS)))
    assert [x.tolist() for x in found] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert list(token_files.Encoder(TOKENIZER).encode(pa.array([], pa.string()))) == []


def random_texts(seed, n=400):
    rng = random.Random(seed)
    pieces = ["word", "Word", "the", "it's", "12", "é", "—", "„", "\u00a0", "\u3000", "\u2003", "\u1680", "\u2028", "\x85", "中文", "\x1c", "<|endoftext|>", "a.b", "x" * 200]
    gaps = [" ", " ", " ", " ", "\n", "\n", "", "  ", "\n\n", "\t", " \n", "\r\n", "\n \n"]
    return ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [0, 5, 10**6])
def test_units_of_all_kinds_of_white_space(monkeypatch, remembered):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(TOKENIZER), random_texts(remembered)
    texts.append(" ".join(texts[:200]) * 3)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    monkeypatch.setattr(token_files, "NEW_UNITS", 7)
    encoder = token_files.Encoder(TOKENIZER)
    for step in (1 << 19, 3000, 100):
        monkeypatch.setattr(token_files.words, "STEP_BYTES", step)
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == expected
    assert len(encoder.hashes) <= remembered


def token_rows():
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    return rows + [(6, "a repeated id"), (6, "a repeated id"), (None, "no id"), (None, None), (-5, "negative")]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(TOKENIZER), token_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    found = token_files.tokenized(df, TOKENIZER).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for doc, text in ordered:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected


def test_access_by_key(spark, tmp_path):
    df = spark.createDataFrame(token_rows(), "doc_id long, text string")
    manifest = token_files.write_tokens(df, str(tmp_path / "t"), TOKENIZER)
    keys = spark.createDataFrame([(0,), (10**15,), (-99,), (1,)], "doc_id long")
    found = token_files.read_tokens(manifest, keys, digest=False).collect()
    from tokenizers import Tokenizer

    assert [(r.doc_id, r.ids) for r in found] == [(0, Tokenizer.from_file(TOKENIZER).encode(TEXTS[0]).ids + [2])]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.tokenized(empty, TOKENIZER).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 20_000])
def test_perfect_hash(n):
    ids = np.arange(n) * 37 - 50
    keys = perfect_hash.document_keys(ids, np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64))
    index = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(index, keys).tolist()) == list(range(n))
    assert len(index["bits"]) * 8 <= 6 * n + 64 * 8
    if n > 1:
        with pytest.raises(ValueError):
            perfect_hash.build(np.r_[keys, keys[:1]])


def test_window_reads_like_the_file(tmp_path):
    data = os.urandom(5000)
    (tmp_path / "x").write_bytes(data)
    system, path = files.located(f"file:{tmp_path}/x")
    with system.open_input_file(path) as file:
        window = files.Window(file, file.size(), step=100)
        for start, length in ((0, 10), (10, 300), (305, 1), (4990, 10), (4999, 50)):
            assert bytes(window.read(start, length)) == data[start : start + length]
