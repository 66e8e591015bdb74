"""Language identification, Merkle fingerprints, class language model."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import brown, langid, merkle, words

SYLLABLES = {
    "en": "the ing tion er an of wh sh ly ea".split(), "de": "sch ung ein ich der ver keit üß ön tz".split(),
    "fr": "eau oi aux les ère ça qui ment elle ê".split(), "es": "ción ll ña que os ado rr mente az ja".split(),
}


def texts(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        made = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        yield i, " ".join(made).capitalize() + ".", lang


SCHEMA = "doc_id long, text string, lang string, score int, lang_pred string"


def test_held_out_languages(spark):
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 !? ²", None), (1003, "The of the thing", None), (None, "Der schung", "de")]
    rows = [*texts(400), *odd, (3, "the thing", "en"), (3, "the thing", "en")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in texts(400)}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in found)
    by = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert [by[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and by[1003][0] == "en"
    assert all(0 <= r.score <= 1 for r in found) and {r.lang_pred for r in found} == {*SYLLABLES, "und"}


def test_labels_of_held_out_documents_are_not_learned(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in texts(200)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert found.where("lang_pred = 'xx'").count() == 0


def test_one_language_no_language_no_rows(spark):
    df = spark.createDataFrame(list(texts(60)), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df.where("lang = 'fr'")).collect()} == {"fr"}
    unlabelled = df.selectExpr("doc_id", "text", "CAST(NULL AS string) lang")
    assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}
    assert langid.identify(df.where("false")).collect() == []


def test_accepted_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in texts(80)] + [(500, "...", "en", 2)], "doc_id long, text string, lang string, _language int")
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.count() == 80


def test_long_texts_are_read_whole():
    part = "The thing of the shing. "
    whole = langid.features(part * 120_000)
    assert np.allclose(whole, langid.features(part * 2000), atol=5e-3) and abs(float(whole @ whole) - 1) < 1e-3
    both = langid.features(part * 60_000 + "ñción lla " * 200_000)
    assert float(both @ langid.features("ñción lla " * 50)) > 0.3


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(1, 0.3, (50, 5)), rng.normal(-1, 0.3, (50, 5))].astype(np.float32)
    y = np.r_[np.ones(50), -np.ones(50)]
    weights = langid.fit_svm(x, y)
    assert (np.sign(x @ weights[:-1] + weights[-1]) == y).all()


def test_svm_holds_its_examples_once():
    x = np.random.default_rng(2).random((200, 4000), dtype=np.float32)
    tracemalloc.start()
    langid.fit_svm(x, np.r_[np.ones(100), -np.ones(100)], rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 4


def test_families():
    assert (langid.family_of("en-US"), langid.family_of("es"), langid.family_of("zz")) == ("germanic", "romance", "zz")


# --- Merkle -----------------------------------------------------------------------------------------------------


def story(n, seed=2):
    rng = random.Random(seed)
    return "".join(f"Sentence {rng.randrange(10**6)} of paragraph {i}.{chr(10) if rng.random() < 0.3 else ' '}" for i in range(n))


def test_trees_tell_equal_from_edited_texts():
    text = story(200)
    assert "".join(merkle.paragraphs(text)) == text
    edit = text.replace("of paragraph 77.", "of an edited paragraph.")
    a, b = merkle.fingerprint(text), merkle.fingerprint(edit)
    assert a == merkle.fingerprint(str(text)) and a.split("/")[0] != b.split("/")[0]
    assert merkle.likeness(a, a) == 1 and 0.95 < merkle.likeness(a, b) < 1 and merkle.likeness(a, b) == merkle.likeness(b, a)
    changed = merkle.differing(a, b)
    flat = [(i, j) for i, (_, leaves) in enumerate(merkle.branches(a)) for j, _ in enumerate(leaves)]
    where = [merkle.paragraphs(text)[flat.index(place)] for place in changed]
    assert len(changed) == 1 and "of paragraph 77." in where[0] and merkle.differing(a, a) == []
    assert merkle.likeness(a, merkle.fingerprint(story(200, seed=9))) == 0


@pytest.mark.parametrize("text", ["", "x", "\n", "\n\n\n", "a\n\nb\n", "no end " * 3000, ". . . ! ?\n", "中" * 1000, "a" * 121])
def test_paragraphs_join_to_the_text(text):
    assert "".join(merkle.paragraphs(text)) == text and max(map(len, merkle.paragraphs(text)), default=0) <= merkle.LONGEST + 1
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_fingerprints_of_a_table(spark, n):
    rng = random.Random(n)
    rows = [(i * 5, rng.choice([None, "", "ab", story(rng.randrange(30), i), "中é" * 9])) for i in range(n)]
    rows += [(5, "again"), (None, "none"), (None, None), (25, rows[5][1])] if n > 9 else []
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(6)
    found = merkle.fingerprints(df).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        edit = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        marks = [merkle.fingerprint(t) for t in (text, edit, following)]
        expected.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), *marks[:2], merkle.likeness(*marks[:2]), merkle.likeness(marks[0], marks[2])))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))


# --- language model -----------------------------------------------------------------------------------------------


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def lm_rows():
    odd = [(500, None, ""), (501, "", ""), (502, "\t ", ""), (None, "no id at all", ""), (503, "W" * 400, ""), (503, "W" * 400, "")]
    return [(i, t) for i, t, _ in [*texts(200, seed=4), *odd, (504, "The THE the " * 30_000, "")]]


def test_base_scores_equal_brute_force_and_classes_beat_them(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNITS", 30)
    monkeypatch.setattr(brown, "RESIDENT", 60)
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int").repartition(5)
    found = brown.scores(df, classes=8).collect()
    held = {r[0]: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows}
    counts = Counter()
    for doc, text in rows:
        if not held[doc]:
            counts.update([*plain_words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for doc, text in rows:
        own = [*plain_words(text), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        expected.append(str((doc, held[doc], len(own), sum(counts[w] > 0 for w in own), total, round(base, 4))))
    assert sorted(str((*r[:5], round(r.base_score, 4))) for r in found) == sorted(expected)
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(math.isclose(math.log10(r.perplexity), -r.score / r.n_tokens, rel_tol=1e-9) for r in found)


def test_exchange_finds_the_blocks():
    pairs = np.kron(np.eye(3), np.ones((6, 6))) * 50 + 1
    order = np.random.default_rng(2).permutation(18)
    of = brown.exchange(pairs[np.ix_(order, order)], 3)
    assert len({tuple(sorted(of[order // 6 == b])) for b in range(3)}) == 3 and all(len(set(of[order // 6 == b])) == 1 for b in range(3))


def test_no_training_documents_and_no_documents(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    found = brown.scores(df).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found} == {(3, 0, 0, 0.0)}
    assert all(r.score < 0 for r in found)
    assert brown.scores(df.where("false")).collect() == []


def test_word_hashes_know_words_by_their_text():
    import pyarrow as pa

    rng = random.Random(6)
    sample = ["".join(rng.choice("aAbBä中") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    column = pa.array([" ".join(sample), None, "", "\t".join(reversed(sample))])
    hashes = {}
    for _, found, offsets in words.texts_to_words(column):
        flat = plain_words(" ".join(sample)) + plain_words("\t".join(reversed(sample)))
        assert len(found) == len(flat)
        for word, value in zip(flat, found.tolist()):
            assert hashes.setdefault(word, value) == value
    assert len(set(hashes.values())) == len(hashes)
    assert [len(x) for x in words.shingle_sets(pa.array(["a b a b", "a", " ", None, "A B"]))] == [2, 1, 0, 0, 1]
