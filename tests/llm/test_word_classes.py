"""Every training word has a class of its own counts, not of its spelling."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stratalens.llm import brown


def test_gains_equal_a_recount():
    rng = np.random.default_rng(5)
    pairs, of = rng.integers(0, 9, (14, 14)).astype(float), rng.integers(0, 4, 14)
    pairs = pairs + pairs.T  # words come as often as they go
    member = np.eye(4)[of]
    table, before, after = member.T @ pairs @ member, pairs.T @ member, pairs @ member
    gain = brown.gains(of, before, after, np.diag(pairs).copy(), table)
    for w in range(14):
        for b in range(4):
            new = member.copy()
            new[w] = np.eye(4)[b]
            assert abs(gain[w, b] - gain[w, of[w]] - brown.likelihood(new.T @ pairs @ new) + brown.likelihood(table)) < 1e-6


def test_rare_words_get_classes_by_their_neighbours(spark, monkeypatch):
    """Two kinds of words alternate; all share one ending, so that spelling says nothing."""
    monkeypatch.setattr(brown, "UNITS", 5)
    monkeypatch.setattr(brown, "RESIDENT", 30)
    rng = np.random.default_rng(1)
    first, second = [f"a{i}xx" for i in range(60)], [f"b{i}xx" for i in range(60)]
    rows = [(i, " ".join(w for _ in range(20) for w in (rng.choice(first), rng.choice(second)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in brown.scores(df, classes=3).collect()}
    held = [found[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    # A class of 60 words is met with certainty: some log10(60) a token, log10(120) if the two kinds were one.
    assert np.mean([-r.score / r.n_tokens for r in held]) < np.log10(60) + 0.1


def test_chances_of_all_words_sum_to_one():
    rng = np.random.default_rng(2)
    n, of = rng.integers(1, 20, 40), rng.integers(0, 5, 40)
    table = np.outer(np.bincount(of, n, 5), np.bincount(of, n, 5)) / n.sum()
    model = brown.WordModel(table, np.bincount(of, minlength=5), rng.integers(0, 5, brown.ENDINGS))
    for before in range(5):
        seen = model.transition[before, of] - model.divisor[of] + np.log10(n + 0.5)
        unseen = model.transition[before, model.group_class] - model.divisor[model.group_class] + np.log10(0.5)
        assert abs((10.0**seen).sum() + (10.0**unseen).sum() - 1) < 1e-9


def test_scores_equal_a_plain_scorer(spark, monkeypatch):
    """The class table is a recount over the training texts, and every score the product of its tokens' chances."""
    monkeypatch.setattr(brown, "UNITS", 6)
    monkeypatch.setattr(brown, "RESIDENT", 25)
    held, inner = {}, brown.word_classes

    def kept(texts, words, frequent, class_of, group_class, classes):
        held["words"], held["groups"] = words, group_class
        held["class_of"], held["rare"], held["table"] = inner(texts, words, frequent, class_of, group_class, classes)
        return held["class_of"], held["rare"], held["table"]

    monkeypatch.setattr(brown, "word_classes", kept)
    rng = np.random.default_rng(7)
    vocabulary = [f"{chr(97 + k % 26)}{chr(97 + k // 5 % 26)}{k}" for k in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 10 + i], rng.integers(0, 60)))) for i in range(130)] + [(900, None), (901, "never seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in brown.scores(df, classes=4).collect()}

    coded = {}
    for doc, text in rows:
        _, hashes, group, _ = next(brown.tokens(pa.array([text or ""])))
        coded[doc] = list(zip(hashes.view(np.int64).tolist(), group.tolist()))
    training = [doc for doc, _ in rows if zlib.crc32(str(doc).encode()) % 5 != 1]
    counts = Counter(word for doc in training for word, _ in coded[doc])
    of = dict(zip(held["words"].tolist(), held["class_of"].tolist())) | {r["word"]: r["class"] for r in held["rare"].collect()}
    assert set(of) == set(counts) and len(held["words"]) < len(of)
    ending = {word: group for doc in training for word, group in coded[doc]}
    end = int(brown.END.view(np.int64))
    table = np.zeros((4, 4))
    for doc in training:
        for (a, _), (b, _) in zip([(end, 0), *coded[doc]], coded[doc]):
            table[of[a], of[b]] += 1
    assert (table == held["table"]).all()
    kinds = np.zeros((brown.ENDINGS, 4))
    for word, group in ending.items():
        kinds[group, of[word]] += 1
    groups = np.where(kinds.any(axis=1), kinds.argmax(axis=1), held["groups"])
    n_kinds = kinds.sum(axis=0) + np.bincount(groups, minlength=4)
    share = np.where(n_kinds > 0, table.sum(axis=0) + 0.5, 0)
    share /= share.sum()
    for doc, _ in rows:
        score, before = 0.0, of[end]
        for word, group in coded[doc]:
            own = of.get(word, int(groups[group]))
            score += np.log10((table[before, own] + 10 * share[own]) / (table[before].sum() + 10))
            score += np.log10((counts[word] + 0.5) / (table[:, own].sum() + 0.5 * n_kinds[own]))
            before = own
        assert abs(score - found[doc].score) < 1e-6 * max(1, abs(score)), doc
