"""The pipeline's stages and its run against plain versions of them."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_near import brute_documents
from test_order import plain_mix, plain_targets, sized
from test_texts import texts
from tokenizers import Tokenizer

from stratalens.llm import mixing, packing, token_files


def documents():
    rng = random.Random(8)
    rows = [(i, t, lang, f"s{rng.randrange(4)}") for i, t, lang in texts(160, seed=8)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s9") for i in range(30)]  # copies
    rows += [(300 + i, rows[i][1] + " more", None, None) for i in range(30)]
    return rows + [(400, None, None, "s1"), (401, "", "en", "s1"), (402, "?! 12", "fr", "s2"), rows[3], rows[3]]


def test_stages_and_run(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(*r, len(r[1] or "")) for r in documents()]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), list(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "language":
            kept = [r for r in kept if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "near_duplicates":
            found = brute_documents([r[:2] for r in kept])
            least = {doc for doc, _, _, keep in found if keep}
            kept = list({r[0]: r for r in kept if r[0] in least}.values())
        elif name == "mixture":
            units = Counter((r[0], r[3], n) for r, (_, n) in zip(kept, sized([r[:2] for r in kept])))
            sizes = defaultdict(int)
            for (_, source, n), times in units.items():
                sizes[source] += n * times
            copies = plain_mix(units, plain_targets(dict(sizes), mixing.WEIGHTS, 1.5, 2), 1.5, 2, mixing.SEED)
            times = {u[0]: copies[u] for u in units}
            kept = [r for r in kept for _ in range(times[r[0]])]
        else:
            break
        assert out.columns == docs.columns
        assert Counter(tuple(r) for r in out.collect()) == Counter(kept), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    batches = out.collect()
    assert name == "batches" and batches == [r for r in batches if r.length <= packing.WINDOW]
    tokens = Counter()
    for r in batches:
        tokens[r.doc_id] += r.length
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    ids = [(r[0], len(library.encode(r[1], add_special_tokens=False).ids)) for r in kept]
    assert tokens == Counter(d for d, n in ids for _ in range(n))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r) for r in run.collect()) == Counter(tuple(r) for r in batches)


CLASHES = "_rank int, _size int, _copy int, _language string, _row int, bucket int, lang_pred string, component_id long"


def test_stages_on_an_empty_table_and_beside_columns_of_their_own_names(spark, tmp_path):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    rows = [(*r, len(r[1] or ""), 1, 2, 3, "x", 4, 5, "y", 6) for r in documents()]
    for name, data in (("empty", []), ("clashing", rows)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns, step
            out.write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
        assert (docs.count() > 0) == bool(data)
        assert all(tuple(r)[5:] == (1, 2, 3, "x", 4, 5, "y", 6) for r in docs.collect())
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == bool(data)
