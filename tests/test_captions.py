import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.functions import overlap, text
from stratalens.functions.stem import STEP_2, STEP_3, STEP_4, with_stems
from stratalens.operators import captions, coding
from plain_porter import porter

CASES = [
    ("", ["a cat sits here"]),
    ("the cat", ["the cat sat on the mat", "a cat"]),
    ("the the the the the", ["the cat is on the mat", "there is a the the"]),
    ("The cat sat, on the mat.", ["the cat lay on a mat", "a cat sat on the mat today", "the cat"]),
    ("a b c d a b c d", ["a b c d", "d c b a d c b a", "b c d e f"]),
    ("go go go go\ngo go", ["go"]),
]


def toks(line):
    return [t for t in re.split(r"[\W_]+", line.lower()) if t]


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu_by_loop(cases, rule="closest"):
    match, total, c, r = [0] * 4, [0] * 4, 0, 0
    for generated, refs in cases:
        p, rs = toks(generated), [toks(x) for x in refs]
        c += len(p)
        r += min(map(len, rs)) if rule == "shortest" else min((abs(len(x) - len(p)), len(x)) for x in rs)[1]
        for n in range(1, 5):
            most = {}
            for reference in rs:
                for g, k in grams(reference, n).items():
                    most[g] = max(most.get(g, 0), k)
            match[n - 1] += sum(min(k, most.get(g, 0)) for g, k in grams(p, n).items())
            total[n - 1] += max(len(p) - n + 1, 0)
    if not all(match):
        return match, total, 0.0
    penalty = 1.0 if c > r else math.exp(1 - r / c)
    return match, total, penalty * math.exp(sum(math.log(m / t) for m, t in zip(match, total)) / 4)


def lcs_by_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def frame(spark, cases):
    rows = [(i, g, r) for i, (g, r) in enumerate(cases)]
    return spark.createDataFrame(rows, "sample_id long, generated string, refs array<string>").repartition(4)


def random_cases(seed, n=60):
    rng = random.Random(seed)
    line = lambda most: " ".join(rng.choice("abcdef") for _ in range(rng.randrange(most)))
    return [(line(30), [line(30) for _ in range(rng.randrange(1, 5))]) for _ in range(n)]


@pytest.mark.parametrize("cases", [CASES, random_cases(1), random_cases(2, 300)])
@pytest.mark.parametrize("rule", ["closest", "shortest"])
def test_bleu_equals_the_loop(spark, cases, rule):
    found = captions.bleu4(frame(spark, cases), length_rule=rule).first()
    match, total, score = bleu_by_loop(cases, rule)
    assert [found[f"match_{n}"] for n in (1, 2, 3, 4)] == match
    assert [found[f"total_{n}"] for n in (1, 2, 3, 4)] == total
    assert found.bleu4 == pytest.approx(score, abs=1e-9)


def test_bleu_of_a_text_with_itself_is_one_and_groups_are_apart(spark):
    df = frame(spark, [("a b c d e", ["a b c d e"]), ("a b c d e", ["x y z"])]).withColumn(
        "run", F.col("sample_id").cast("string")
    )
    assert {r.run: r.bleu4 for r in captions.bleu4(df, keys=("run",)).collect()} == {"0": 1.0, "1": 0.0}


def test_bleu_of_empty_predictions_is_zero(spark):
    assert captions.bleu4(frame(spark, [("", ["a"]), ("...", ["b c"])])).first().bleu4 == 0.0


def test_clip_counts_of_an_empty_batch_and_sliced_input():
    strings, lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))
    assert overlap.clip_counts(strings, lists)[0].shape == (0, 4)
    whole = pa.array(["x", "a b a"]), pa.array([["x"], ["a a", "b"]])
    matches, lengths, refs = overlap.clip_counts(*(column.slice(1) for column in whole))
    assert matches.tolist() == [[3, 0, 0, 0]] and lengths.tolist() == [3]
    assert [r.tolist() for r in refs] == [[2, 1]]


def test_lcs_equals_the_table():
    assert overlap.lcs_length("the cat sat on the mat".split(), "the cat lay on a mat".split()) == 4
    assert overlap.lcs_length("b a b a b".split(), "a b b a".split()) == 3
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        assert overlap.lcs_length(a, b) == lcs_by_table(a, b) <= min(len(a), len(b))


def test_rouge_uses_the_first_reference(spark):
    cases = CASES + random_cases(4)
    found = {r.sample_id: r.rouge_l for r in captions.rouge_l_scores(frame(spark, cases)).collect()}
    for i, (generated, refs) in enumerate(cases):
        p, r = toks(generated), toks(refs[0])
        expected = 2 * lcs_by_table(p, r) / (len(p) + len(r)) if p or r else 0.0
        assert found[i] == pytest.approx(expected)
    mean = captions.mean_score(captions.rouge_l_scores(frame(spark, cases)), "rouge_l").first()
    assert (mean.n_samples, mean.rouge_l) == (len(cases), pytest.approx(sum(found.values()) / len(cases)))


def test_no_reference_is_an_error(spark):
    with pytest.raises(Exception):
        captions.rouge_l_scores(frame(spark, [("a", [])])).collect()


def meteor_by_loop(predicted, reference, same):
    used, pairs = set(), {}
    for test in same:
        for i, p in enumerate(predicted):
            if i in pairs:
                continue
            for j, r in enumerate(reference):
                if j not in used and test(p, r):
                    pairs[i] = j
                    used.add(j)
                    break
    if not pairs:
        return 0.0
    chunks, last = 0, None
    for i in sorted(pairs):
        if last is None or i != last + 1 or pairs[i] != pairs[last] + 1:
            chunks += 1
        last = i
    m = len(pairs)
    p, r = m / len(predicted), m / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def test_meteor_stages(spark):
    cases = CASES + random_cases(6) + [
        ("cats running quickly home", ["a cat runs home quick"]),
        ("the big dog walked walked", ["a large hound walks walking big"]),
    ]
    groups = [{"big", "large"}, {"dog", "hound"}, {"a", "f"}, {"b", "e"}, {"a", "e"}, {"d"}]
    synsets = spark.createDataFrame([(w, f"s{k}") for k, g in enumerate(groups) for w in sorted(g)], "word string, synset string")
    one_each = spark.createDataFrame([(w, k) for k, g in enumerate(groups[:2] + [set("abc")]) for w in sorted(g)], "word string, synset int")
    exact = lambda p, r: p == r
    stem = lambda p, r: porter(p) == porter(r)
    synonym = lambda p, r: any(p in g and r in g for g in groups)
    once = lambda p, r: any(p in g and r in g for g in groups[:2] + [set("abc")])
    for options, tests in [
        ({"stemming": False}, [exact]),
        ({"stemming": True}, [exact, stem]),
        ({"stemming": True, "synsets": synsets}, [exact, stem, synonym]),
        ({"stemming": False, "synsets": one_each}, [exact, once]),
    ]:
        found = {r.sample_id: r.meteor for r in captions.meteor_scores(frame(spark, cases), **options).collect()}
        assert len(found) == len(cases)
        for i, (generated, refs) in enumerate(cases):
            assert found[i] == pytest.approx(meteor_by_loop(toks(generated), toks(refs[0]), tests)), (i, options)


def test_porter_on_the_examples_of_the_paper(spark):
    pairs = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor
    sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss filing file happy happi
    sky sky relational relat conditional condit digitizer digit vietnamization vietnam operator oper hopefulness hope
    sensibiliti sensibl triplicate triplic formalize formal electrical electr goodness good revival reviv
    adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas
    controll control roll roll""".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]
    rng = random.Random(11)
    words = pairs + ["", "y", "yy", "ayying", "byyed", "yed", "ying", "\u00e9t\u00e9s", "123ing", "\u732b", "\u732b\u732bs"]
    endings = [*STEP_2, *STEP_3, *STEP_4, "s", "ies", "sses", "eed", "ed", "ing", "y", "e", "ll", "yyed", "tted"]
    words += ["".join(rng.choice("aeiouybcdlstxw") for _ in range(rng.randrange(7))) + rng.choice(endings) for _ in range(4000)]
    found = with_stems(spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")).collect()
    assert [(r.word, r.stem) for r in found if r.stem != porter(r.word)] == []


def test_meteor_in_small_chunks_and_of_texts_without_words(spark, monkeypatch):
    cases = random_cases(9, 120) + [("", [""]), ("...", ["a"]), ("a", ["--"])]
    whole = {r.sample_id: r.meteor for r in captions.meteor_scores(frame(spark, cases)).collect()}
    monkeypatch.setattr(coding, "CHUNK_WORDS", 40)
    assert {r.sample_id: r.meteor for r in captions.meteor_scores(frame(spark, cases)).collect()} == whole
    assert len(whole) == len(cases) and whole[len(cases) - 1] == 0.0
    assert captions.meteor_scores(frame(spark, cases).where("false")).collect() == []
    only = captions.meteor_scores(frame(spark, [("", [""]), (None, [None])])).collect()
    assert [r.meteor for r in only] == [0.0, 0.0]


def test_inspection_rows(spark):
    df = spark.createDataFrame(
        [(7, 42, "  a cat \n", [" one ", "two"]), (1234, 5, " \n ", ["x"])],
        "sample_idx long, coco_id long, generated string, refs array<string>",
    )
    assert [tuple(r) for r in captions.comparison_rows(df).collect()] == [
        (7, 42, "a cat", ["one", "two"], 2, "sample_007_coco42.jpg"),
        (1234, 5, "(empty)", ["x"], 1, "sample_1234_coco5.jpg"),
    ]


def test_references_and_first_sentence(spark):
    df = spark.createDataFrame(
        [(None, "one", "A dog. More"), (["x"], None, "No mark\nKeywords\ndog, dog"), (["y"], "z", "  Hi! Hi!")],
        "refs array<string>, caption string, generated string",
    )
    refs = captions.normalise_refs(F.col("refs"), F.col("caption"))
    found = df.select(refs, text.first_sentence(F.col("generated")), text.has_suffix(F.col("generated"))).collect()
    assert [tuple(r) for r in found] == [
        (["one"], "A dog.", False), (["x"], "No mark", True), (["y"], "Hi!", False)
    ]


def test_repetition(spark):
    loop = "This is it.\n" * 4
    df = spark.createDataFrame([(loop,), ("all words differ",), ("",)], "g string")
    found = df.select(text.line_repetition(F.col("g")), text.token_repetition(F.col("g"))).collect()
    assert [tuple(r) for r in found] == [(4.0, 4.0), (1.0, 1.0), (None, None)]


def test_match_references(spark):
    samples = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "sample_id long, refs array<string>")
    made = spark.createDataFrame([(1, "x")], "sample_id long, generated string")
    assert [tuple(r) for r in captions.match_references(made, samples).collect()] == [(1, "x", ["a"])]


def test_bleu_plan_shuffles_no_ngrams(spark):
    plan = captions.bleu4(frame(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert np.isfinite(captions.bleu4(frame(spark, CASES)).first().bleu4)


def test_meteor_of_a_chunk_is_aligned_in_steps(spark, monkeypatch):
    """Texts of one chunk are aligned some at a time, with the scores that the whole chunk gives."""
    rng = random.Random(5)
    words = ["run", "runs", "running", "cat", "cats", "dog", "a", "the"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(400)] + [""]
    flat = pa.array(texts + texts[::-1]).dictionary_encode()  # each text stands for one word here
    codes = pa.array([[c] * (c % 40) for c in flat.indices.to_pylist()], pa.list_(pa.int32()))
    table = pa.table({"p": codes[: len(texts)], "r": codes[len(texts) :]})
    monkeypatch.setattr(coding, "STEP_WORDS", 500)
    parts = list(coding.steps(table, ["p", "r"]))
    assert len(parts) > 5 and pa.concat_tables(parts).equals(table)
    assert max(sum(map(len, part.column("p").to_pylist() + part.column("r").to_pylist())) for part in parts) < 500 + 80
    whole = overlap.meteor(*(captions._lists(table, name) for name in ("p", "r")))
    again = np.concatenate([overlap.meteor(*(captions._lists(part, name) for name in ("p", "r"))) for part in parts])
    assert (whole == again).all()
