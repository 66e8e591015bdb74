"""Near-duplicate documents and vectors against brute force; components against union-find."""

import random

import numpy as np
import pytest

from stratalens.llm import embeddings, minhash
from stratalens.llm.components import connected_components


class Forest:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(120)] + [(7, 7), (None, 3)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(150)],
        "none": [],
    }[shape]
    forest = Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in found} == {v: forest.find(v) for v in list(forest.parent)}
    assert len(found) == len(forest.parent)


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def brute_documents(rows):
    sets, forest = {}, Forest()
    for doc, text in rows:
        if doc is not None:
            forest.find(doc)
            sets.setdefault(doc, []).append(shingles(text))
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                forest.join(a, b)
    return sorted(
        ((doc, len(shingles(text)), None if doc is None else forest.find(doc), doc is None or forest.find(doc) == doc) for doc, text in rows),
        key=str,
    )


def near_copies(rng, n):
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def documents():
    rng = random.Random(5)
    texts = [*near_copies(rng, 90), *near_copies(rng, 40), *["same Text twice"] * 30]
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "ONE", "one\x0b", " ", "Äb c", "äb c", "long " * 40_000, "LONG " * 40_001]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [rows[3], (4, "another text under the same id"), (None, "same text twice"), (None, None)]


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HUB_PARTNERS", 4)
    rows = documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, kept int")
    found = sorted((tuple(r) for r in minhash.near_duplicates(df.repartition(7)).collect()), key=str)
    assert found == brute_documents(rows)


def test_templates_without_links_stay_apart_and_outliers_are_found(spark, monkeypatch):
    """All share bands with all, few are linked: the buckets are compared in full."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, common = random.Random(9), [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(common + [f"u{i}_{k}" for k in range(14)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(10, 50, 7)]
    rng.shuffle(rows)
    found = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == brute_documents(rows)


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _rank int")
    left = minhash.deduplicated(df)
    assert left.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in left.collect() if shingles(r.text) and r.doc_id is not None)
    wanted = {}
    for doc, n, component, keep in brute_documents(rows):
        if keep and n and doc is not None:
            wanted[doc] = min(t for d, t in rows if d == doc and shingles(t))
    assert kept == sorted(wanted.items())
    assert left.where("doc_id IS NULL").count() == 2
    assert left.count() == len(kept) + 2 + sum(not shingles(t) for d, t in rows if d is not None)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == [] and minhash.deduplicated(empty).collect() == []


def brute_vectors(rows):
    forest, links, usable = Forest(), {}, []
    for k, (vec, v) in enumerate(rows):
        good = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, dtype=np.float64) / np.linalg.norm(v) if good else None)
        links[k] = 0
    for i, a in enumerate(usable):
        for j, b in enumerate(usable[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                forest.join(i, j)
    least = {}
    for k, (vec, _) in enumerate(rows):
        root = forest.find(k)
        least[root] = vec if least.get(root) is None else least[root] if vec is None else min(least[root], vec)
    return sorted((str((vec, links[k], least[forest.find(k)])) for k, (vec, _) in enumerate(rows)))


def vectors():
    rng = np.random.default_rng(4)
    rows, vec = [], 0
    for size, noise in ((60, 0.02), (40, 0.04), (12, 0.055), *[(1, 0)] * 80):
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((vec, (centre / np.linalg.norm(centre) + noise * rng.standard_normal(32)).astype(np.float32).tolist()))
            vec += 1
    rows += [(vec + i, rows[5][1]) for i in range(20)]  # exact copies
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0, None]), (905, [float("inf"), 1.0])]
    rows += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-0.0, 1.0]), (909, [0.0, 1.0]), (5, rows[5][1]), (None, rows[7][1])]
    return rows


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n_links int").repartition(5)
    found = embeddings.near_vectors(df, recall=0.99999).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in found) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 10_000, 10**9])
def test_plan_reaches_the_recall(n):
    bits, tables = embeddings.plan(n)
    hit = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 8 <= bits <= 30 and 1 - (1 - hit) ** tables >= embeddings.RECALL
