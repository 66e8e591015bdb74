import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratalens import schemas
from stratalens.operators.blocks import best_block
from stratalens.sources import reports, tables


def report(model, n, rows, best, blank=" "):
    lines = [f"Analysis of Layer Similarities for {model}{blank}", f"Number of Layers to Skip : {n} ", reports.HEADER]
    return "\n".join([*lines, *rows, f"Layer {best} to {best + n} is the best block to prune.", ""])


def test_reads_framed_reports(spark, tmp_path):
    folder = tmp_path / "some_set"
    folder.mkdir()
    (folder / "distances_m_x_2.csv").write_text(report("m_x", 2, ["1,3,0.5", "2,4,0.25"], 2))
    (folder / "distances_m_x_10.csv").write_text(report("m_x", 10, ["1,11,nan"], 1, blank=""))
    (folder / "distances_m_x_26.csv").write_text(report("m_x", 26, [], 0).replace("\n", "\r\n"))
    rows, best = reports.read_distance_reports(spark, str(folder))
    found = {(r.dataset, r.model, r.n, r.block_start, r.block_end, str(r.average_distance)) for r in rows.collect()}
    assert found == {
        ("some_set", "m_x", 2, 1, 3, "0.5"), ("some_set", "m_x", 2, 2, 4, "0.25"), ("some_set", "m_x", 10, 1, 11, "nan")
    }
    assert {tuple(r) for r in best.collect()} == {("some_set", "m_x", 2, 2, 4), ("some_set", "m_x", 10, 1, 11)}


@pytest.mark.parametrize("layout", ["text", "table"])
def test_report_round_trip(spark, tmp_path, layout):
    data = [("my set:1+50%", m, n, s, s + n, 0.1 * s / n) for m in ("a b", "c") for n in (1, 2) for s in range(1, 6 - n)]
    rows = spark.createDataFrame(data, "dataset string, model string, n int, block_start int, block_end int, average_distance double")
    path = str(tmp_path / "out")
    reports.write_distance_reports(rows, path, layout)
    if layout == "text":
        stored, named = reports.read_distance_reports(spark, path)
        expected = best_block(rows, reports.KEYS).drop("average_distance")
        assert {tuple(r) for r in named.collect()} == {tuple(r) for r in expected.collect()}
    else:
        stored = spark.read.parquet(path)
    assert {tuple(r) for r in stored.select(*rows.columns).collect()} == set(data)


def test_a_size_without_rows_has_a_report(spark, tmp_path):
    rows = spark.createDataFrame([("d", "m", 1, 1, 2, 0.5)], "dataset string, model string, n int, block_start int, block_end int, average_distance double")
    sizes = spark.createDataFrame([("d", "m", 1), ("d", "m", 26)], "dataset string, model string, n int")
    path = tmp_path / "out"
    reports.write_distance_reports(rows, str(path), "text", sizes)
    text = next((path / "dataset=d" / "model=m" / "n=26").glob("*.txt")).read_text()
    assert text == f"Analysis of Layer Similarities for m \nNumber of Layers to Skip : 26 \n{reports.HEADER}\n"
    stored, best = reports.read_distance_reports(spark, str(path))
    assert [r.n for r in stored.collect()] == [1] and [r.n for r in best.collect()] == [1]


def test_names(spark):
    paths = ["a/distances_m_12.csv", "a/distances_m.csv", "a/plain.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = df.select(reports.file_suffix_number(F.col("p")), reports.report_label(F.col("p"), "distances_m"))
    assert [tuple(r) for r in found.collect()] == [(12, "12"), (0, "base"), (0, "plain")]
    trailer = spark.createDataFrame([("Layer 14 to 9 is the best",)], "t string")
    assert tuple(trailer.select(reports.parse_best_block(F.col("t"))).first()[0]) == (9, 14)


def test_captions(spark, tmp_path):
    sample = {"sample_idx": 0, "coco_id": 5, "url": "u", "img_file": "f", "generated": "g\nh", "refs": ["a", "b"]}
    envelope = tmp_path / "captions.json"
    envelope.write_text(json.dumps({"model_id": "m", "prompt": "p", "samples": [sample, sample]}, indent=2))
    read = tables.read_captions(spark, str(envelope), layout="envelope")
    assert read.count() == 2
    out = str(tmp_path / "lines")
    tables.write_captions(read.withColumn("payload", F.lit(b"x")), out)
    stored = tables.read_captions(spark, out)
    assert stored.first().asDict() == {"model_id": "m", "prompt": "p", **sample} and stored.count() == 2


def test_energy_log_and_missing_file(spark, tmp_path):
    names = [f.strip().split(" ")[0] for f in schemas.ENERGY_LOG.replace("\n", " ").split(",")]
    assert len(names) == 38
    row = {"timestamp": "2026-04-28T15:25:30", "project_name": "p", "emissions": "0.5", "energy_consumed": "2.5", "cpu_model": "Intel(R), x"}
    cells = [f'"{row[n]}"' if "," in row.get(n, "") else row.get(n, "") for n in names]
    path = tmp_path / "emissions.csv"
    path.write_text(",".join(names) + "\n" + ",".join(cells) + "\n")
    log = tables.read_energy_log(spark, str(path))
    assert log.first().cpu_model == "Intel(R), x" and str(log.first().timestamp) == "2026-04-28 15:25:30"
    assert tuple(tables.energy_totals(log).first()) == (2.5, 0.5)
    missing = tables.read_energy_log(spark, str(tmp_path / "none.csv"))
    assert missing.columns == log.columns and tuple(tables.energy_totals(missing).first()) == (0.0, 0.0)


def test_energy_log_goes_by_name(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("energy_consumed,run_id,project_name,timestamp,odd\n2.5,r,p,2026-04-28T15:25:30,x\n?,s,q,,y\n")
    first, second = tables.read_energy_log(spark, str(path)).orderBy("run_id").collect()
    assert (first.project_name, first.run_id, first.energy_consumed, first.emissions) == ("p", "r", 2.5, None)
    assert (second.project_name, second.energy_consumed, second.timestamp) == ("q", None, None)


def test_items_read_only_the_scored_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", ["a"], 0, "test"), (2, "r", ["b"], 0, "train")], schemas.ITEMS["mmlu"] + ", split string")
    path = str(tmp_path / "items")
    df.write.partitionBy("split").parquet(path)
    items = tables.read_items(spark, path, "mmlu")
    assert [r.item_id for r in items.collect()] == [1]
    assert "PartitionFilters: [isnotnull(split" in items._jdf.queryExecution().executedPlan().toString()


def test_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "dev")], "text string, split string").write.partitionBy("split").json(path)
    found = tables.read_corpus(spark, path, fmt="json", split="train", order="text", first=1)
    assert [r.text for r in found.collect()] == ["a"]


def test_run_results_history_plans_payloads(spark, tmp_path):
    record = {"run_id": "r", "n_samples": 2, "quality": {"bleu4": 0.5}, "hardware": {"device": "cpu", "total_vram_mib": 0}}
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r.json").write_text(json.dumps(record, indent=2))
    read = tables.read_run_results(spark, str(runs), layout="files")
    assert read.first().quality.bleu4 == 0.5 and read.first().hardware.total_vram_mib == 0.0
    lines = str(tmp_path / "lines")
    tables.write_run_results(read, lines)
    tables.write_run_results(read, lines)
    assert tables.read_run_results(spark, lines).count() == 2

    history = str(tmp_path / "history")
    for seq in (1, 2):
        tables.append_history(spark.createDataFrame([("r", seq, 0.5 * seq)], schemas.HISTORY), history)
    assert [r.accuracy for r in tables.read_history(spark, history).orderBy("seq").collect()] == [0.5, 1.0]
    rows = spark.createDataFrame([("r", 2, 9.0), ("s", 1, 0.25)], schemas.HISTORY)
    tables.append_history(rows, history)
    tables.append_history(rows, history)
    rows.write.parquet(f"{history}/data/append=never-published")
    found = sorted(tuple(r) for r in tables.read_history(spark, history).collect())
    assert found == [("r", 1, 0.5), ("r", 2, 1.0), ("s", 1, 0.25)]
    with ThreadPoolExecutor(4) as pool:
        one = [spark.createDataFrame([("t", i % 3, float(i % 3))], schemas.HISTORY) for i in range(6)]
        list(pool.map(lambda entry: tables.append_history(entry, history), one))
    found = sorted(tuple(r) for r in tables.read_history(spark, history).where("run_id = 't'").collect())
    assert found == [("t", 0, 0.0), ("t", 1, 1.0), ("t", 2, 2.0)]
    assert len(list((tmp_path / "history" / "log").glob("*.json"))) == 10
    arrays = tmp_path / "arrays"
    arrays.mkdir()
    (arrays / "first.json").write_text(json.dumps([0.5, 0.25], indent=2))
    found = tables.read_history(spark, str(arrays), layout="array").orderBy("seq")
    assert [tuple(r) for r in found.collect()] == [("first", 1, 0.5), ("first", 2, 0.25)]
    (arrays / "first.json").write_text("[0.5, ")
    with pytest.raises(Exception):
        tables.read_history(spark, str(arrays), layout="array").collect()
    tables.append_history(rows, str(tmp_path / "broken"))
    next((tmp_path / "broken" / "data").glob("*/*.parquet")).write_text("not parquet")
    with pytest.raises(Exception):
        tables.read_history(spark, str(tmp_path / "broken")).collect()

    images = tmp_path / "images"
    images.mkdir()
    (images / "a.jpg").write_bytes(b"123")
    (images / "note.txt").write_text("x")
    found = tables.read_payloads(spark, str(images), glob="*.jpg").collect()
    assert [(r.img_file, r.length, bytes(r.payload)) for r in found] == [("a.jpg", 3, b"123")]
