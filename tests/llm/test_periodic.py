"""Runs of words against a search of all starts and periods."""

import random
import re
import zlib

import numpy as np
import pytest

from stratalens.llm import periodic


def all_runs(words, least_words=6, least_periods=4):
    found, seen = [], set()
    for p in range(1, len(words) // least_periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            start, length = i, j - i + p
            if j > i and length >= max(least_words, least_periods * p) and (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequence(rng):
    n = rng.randrange(0, 120)
    words = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(n)]
    while rng.random() < 0.7:
        block = [rng.choice("abcx") for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (block * rng.randrange(2, 9))[: rng.randrange(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = sequence(rng)
        first = {}
        ids = np.array([first.setdefault(w, i) for i, w in enumerate(words)], dtype=np.int64)
        assert periodic.runs_of(ids) == all_runs(words)
        if len(words):
            assert periodic.runs_of(ids, 9, 3) == all_runs(words, 9, 3)


def test_long_texts_of_one_word_and_of_words_that_alternate():
    assert periodic.runs_of(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    assert periodic.runs_of(np.tile([0, 1, 2], 20_000)) == [(0, 60_000, 3)]
    assert periodic.runs_of(np.arange(50_000)) == []
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(5, dtype=np.int64), 3, 2)
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(5, dtype=np.int64), 30, 1)


ODD = [
    (900, None), (901, ""), (902, " \t\n\x0b "), (903, "x " * 6), (903, "x " * 6), (None, "no id " * 7), (None, None),
    (904, "a b " * 3 + "a"), (905, "A a " * 4), (906, "é　é é　é é　é é　é é　é é　é"), (907, "one two three\tfour " * 25_000),
]


def planted(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_texts(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\t\n", "  "]).join(sequence(rng))) for i in range(300)] + ODD
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, Runs string, collapsed int").repartition(5)
    found = periodic.periodic_runs(docs).collect()
    assert len(found) == len(rows)

    def shown(doc_id, words, runs):
        drop = {i for s, m, p in runs for i in range(s + p, s + m)}
        return str((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in drop)))

    expected = [shown(d, w := split(t), all_runs(w) if len(w) < 10_000 else [(0, len(w), 4)]) for d, t in rows]
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in found) == sorted(expected)
    assert periodic.periodic_runs(docs.where("false")).collect() == []


def test_planted_runs_and_digest_columns(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(90)))) for i in range(400)] + ODD[:-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic.with_planted_runs(docs).collect()
    assert sorted(str((r.doc_id, split(r.text))) for r in found) == sorted(str((d, planted(d, split(t)))) for d, t in rows)
    runs = periodic.periodic_runs(docs).select("runs", periodic.longest("runs").alias("best"), periodic.listed("runs").alias("listed")).collect()
    for row in runs:
        own = [tuple(r) for r in row.runs]
        assert row.listed == "".join(f"{s},{m},{p}\n" for s, m, p in own)
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (tuple(row.best) if row.best else None) == best
