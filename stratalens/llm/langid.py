"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.llm.common import crc32_of, free_name
from stratalens.session import save_shared

#: ISO 639-1 codes by language family. A language that stands nowhere is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt tk",
    "indic": "hi ur bn pa gu mr ne si",
    "celtic": "ga gd cy br",
    "semitic": "ar he mt am",
}
UNDETERMINED = "und"

#: Parameters of the registered query: bound on the labelled sample of each language and of each family, feature
#: buckets, longest character n-gram, cost of a margin error, rounds of the solver, slope of the score.
SAMPLE = 400
BUCKETS = 1 << 13
LONGEST = 4
COST = 10.0
ROUNDS = 30
SLOPE = 4.0
#: A document below this score is rejected: neither stage then had more than a weak preference.
LEAST_SCORE = 0.3

STEP = 1 << 20
_LETTERS: list[np.ndarray] = []


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), lang)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed character 1- to 4-grams of the lower-cased letters; None without a letter.

    Runs of other characters count as one space. The vector has length 1.
    """
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    counts, kept, before = np.zeros(BUCKETS), [], False
    for at in range(0, len(text or ""), STEP):
        points = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le"), dtype=np.uint32)
        is_letter = _LETTERS[0][points]
        kept.append(np.where(is_letter, points, np.uint32(32))[is_letter | np.r_[before, is_letter[:-1]]])
        before = bool(is_letter[-1])
    if not any((points != 32).any() for points in kept):
        return None
    points = np.concatenate([np.array([32], dtype=np.uint32), *kept, np.array([32], dtype=np.uint32)])
    for at in range(0, len(points), STEP):
        own = points[at : at + STEP + LONGEST - 1]
        gram = np.zeros(len(own) + 1, dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            gram = gram[:-1] * np.uint32(0x01000193) + own[n - 1 :] + np.uint32(n)
            new = min(STEP, len(gram))  # what starts later belongs to the next step
            counts += np.bincount((gram[:new] * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=BUCKETS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent (Hsieh et al., 2008).

    One example at a time is taken in double precision, so ``x`` is not held a second time.
    """
    own = np.ones(x.shape[1] + 1)  # the last is the bias
    norms, alpha, weights = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(own))
    for i in range(len(x)):
        own[:-1] = x[i]
        norms[i] = (own * own).sum()
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            own[:-1] = x[i]
            gradient = y[i] * (own @ weights) - 1
            moved = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            weights += (moved - alpha[i]) * y[i] * own
            alpha[i] = moved
    return weights


class Model:
    """Pairwise weights of the families and of the languages within each family."""

    def __init__(self, langs: list[str], weights: Mapping[tuple[str, str, str], np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.pairs = sorted(weights)
        self.weights = np.stack([weights[p] for p in self.pairs]).T if self.pairs else np.zeros((BUCKETS + 1, 0))

    def _chances(self, group: str, names: list[str], margins: np.ndarray) -> np.ndarray:
        """For every row, each name's mean chance of winning its duels."""
        won = np.zeros((len(margins), len(names)))
        for k, (stage, a, b) in enumerate(self.pairs):
            if stage == group and a in names and b in names:
                chance = 1 / (1 + np.exp(-SLOPE * np.clip(margins[:, k], -50, 50)))
                won[:, names.index(a)] += chance
                won[:, names.index(b)] += 1 - chance
        return won / (len(names) - 1) if len(names) > 1 else np.ones((len(margins), 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.weights[:-1] + self.weights[-1]
        names = sorted(self.families)
        family = self._chances("family", names, margins)
        lang, score = np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        for k, name in enumerate(names):
            own = np.flatnonzero(family.argmax(axis=1) == k)
            if len(own):
                langs = self.families[name]
                chance = self._chances(f"in {name}", langs, margins[own])
                lang[own] = np.array(langs, dtype=object)[chance.argmax(axis=1)]
                score[own] = family[own, k] * chance.max(axis=1)
        return lang, score


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents per language, chosen by a hash of their id.

    Read are doc_id, text and lang of documents whose crc32(doc_id) mod 5 is
    not 0 and whose lang is not NULL. The sample is drawn first by a share of
    each language, so only some more than the bound is sorted. Every duel (two
    families, or two languages of a family) is trained by a task of its own on
    at most twice the bound; only the duels' weights come to the driver.
    """
    labelled = docs.where((crc32_of(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", "text", F.xxhash64(F.lit(1), "doc_id").alias("_hash"))
    counts = save_shared(
        docs.where((crc32_of(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull())
        .groupBy("lang").agg(F.count("*").alias("_n")),
        "lang-counts",
    )
    # A third above the bound, and some, so that the bound is reached but for chance.
    share = (F.lit(1.3 * sample) + 50) / F.col("_n")
    likely = labelled.join(counts, "lang").where(F.pmod("_hash", F.lit(1 << 20)) < share * (1 << 20))
    first = Window.partitionBy("lang").orderBy("_hash")
    chosen = likely.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample)

    @F.arrow_udf("binary")
    def featured(texts: pa.Array) -> pa.Array:
        found = (features(text.as_py()) for text in texts)
        return pa.array([None if x is None else x.tobytes() for x in found], pa.binary())

    chosen = save_shared(
        chosen.select("lang", "_rank", featured("text").alias("x")).where("x IS NOT NULL"), "lang-sample"
    )
    langs = sorted(row["lang"] for row in chosen.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    duels = [("family", a, b, side, lang, -(-sample // len(families[name])))
             for a, b in combinations(sorted(families), 2) for side, name in ((1, a), (-1, b)) for lang in families[name]]
    duels += [(f"in {name}", a, b, side, lang, sample)
              for name, own in families.items() for a, b in combinations(own, 2) for side, lang in ((1, a), (-1, b))]
    if not duels:
        return Model(langs, {})
    table = docs.sparkSession.createDataFrame(duels, "stage string, a string, b string, y int, lang string, most int")
    examples = chosen.join(F.broadcast(table), "lang").where("_rank <= most")  # one row per duel and language

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "lang", "_rank"], kind="stable")
        x = np.stack([np.frombuffer(row, dtype=np.float32) for row in group["x"]])
        weights = fit_svm(x, group["y"].to_numpy(dtype=np.float64))
        return pd.DataFrame([[*key, weights.tobytes()]], columns=["stage", "a", "b", "w"])

    fitted = examples.groupBy("stage", "a", "b").applyInPandas(fit, "stage string, a string, b string, w binary")
    return Model(langs, {(r["stage"], r["a"], r["b"]): np.frombuffer(r["w"]) for r in fitted.collect()})


def predictor(model: Model):
    """A function of a text column: struct of lang_pred and score."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            for at in range(0, len(texts), 64):
                found = [features(text.as_py()) for text in texts.slice(at, 64)]
                some = [i for i, x in enumerate(found) if x is not None]
                if some and model.families:
                    rows = at + np.array(some)
                    langs[rows], scores[rows] = model.predict(np.stack([found[i] for i in some]))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return predict


def held_out(doc_id: Column) -> Column:
    return crc32_of(doc_id) % 5 == 0


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    A NULL text or one without a letter is ``und`` with score 0, and so is
    every text if no labelled document could be learned from. A single
    learned language is predicted for all others. A NULL id counts as the
    empty text in the split; repeated rows are predicted each; other columns
    are not read. Each text is read whole, in steps.
    """
    predict = predictor(train(docs) if model is None else model)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is determined with at least ``least_score``."""
    name = free_name(docs, "_language")
    judged = docs.withColumn(name, predictor(train(docs))(F.col("text")))
    good = (F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= least_score)
    return judged.where(good).select(*[docs[c] for c in docs.columns])
