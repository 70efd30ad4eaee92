"""Readers and writers on small files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from querent.operators import models, reports, standardize, verify
from querent.sources import readers, sinks
from querent.streaming import incremental


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_records_and_answers(spark, tmp_path):
    def item(c, corrupted, clean):
        return {"complexity": c, "is_corrupted": True, "verification_result": {"vqa_results": [{"answer_corrupted": corrupted, "answer_clean": clean}]}}

    no = [{"pages": ["a/p1.jpg"], "answer": "?", "answer_converted": "unable to determine"}]
    yes = [{"pages": ["p1.jpg"], "answer": "x", "answer_converted": "x"}]
    path = put(tmp_path / "n.json", {"corrupted_questions": [item(1, no, no), item(2, no, yes), item(2, "not a list", yes), {"is_corrupted": True, "verification_result": "Not Applicable"}]})
    records = verify.valid_results(readers.records(spark, path))
    assert records.count() == 3
    assert [r["is_unable"] for r in verify.window_answers(records, "clean").orderBy("qid").collect()] == [True, False, False]
    assert verify.window_answers(records).count() == 2


def test_question_file(spark, tmp_path):
    put(tmp_path / "validation.json", {"dataset_name": "DUDE", "base_image_dir": "d", "data": [{"questionId": "1", "question": "q", "answers": ["a"], "document": ["p"]}]})
    row = readers.question_file(spark, str(tmp_path), "val", "DUDE").first()
    assert (row["questionId"], row["answers"], row["image_path"]) == ("1", ["a"], ["p"])
    with pytest.raises(ValueError):
        readers.question_file(spark, str(tmp_path), "val", "other")


def test_ocr(spark, tmp_path):
    box = {"BoundingBox": {"Width": 1.0, "Height": 1.0, "Left": 0.0, "Top": 0.0}}
    a = put(tmp_path / "a.json", {"LINE": [{"Text": "one", "Geometry": box}, {"Text": "two"}]})
    assert [r["text"] for r in readers.ocr(spark, a, "MPDocVQA").collect()] == ["one"]
    b = put(tmp_path / "b.json", [{"Blocks": [{"BlockType": "LINE", "Text": "x", "Geometry": box}, {"BlockType": "WORD", "Text": "y"}]}])
    c = put(tmp_path / "c.json", {"Blocks": [{"BlockType": "LINE", "Text": "z", "Geometry": box}]})
    assert sorted(r["text"] for r in readers.ocr(spark, [b, c], "DUDE").collect()) == ["x", "z"]
    with pytest.raises(ValueError):
        readers.ocr(spark, a, "SlideVQA")


def test_layout(spark, tmp_path):
    path = put(tmp_path / "aug.json", {"q1": {"question_data": {"question": "?"}, "layout_analysis": {"pages": {"p2": {"image_path": "i", "layout_analysis": {"object1": {"BBOX": [1, 2, 3, 4], "ObjectType": "table", "OCR": "t"}}}}}}})
    row = readers.layout_objects(readers.augmented(spark, path)).first()
    assert (row["key"], row["page_id"], row["obj_id"], row["BBOX"], row["ObjectType"]) == ("q1", "p2", "object1", [1, 2, 3, 4], "table")


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([("ab",), ("abc",)], "doc string")
    files = spark.createDataFrame([("ab_1.jpg",), ("ab_10.jpg",), ("abc_2.jpg",)], "file string")
    strict = {(r["doc"], r["file"]) for r in readers.pages_of_documents(docs, files).collect()}
    assert strict == {("ab", "ab_1.jpg"), ("ab", "ab_10.jpg"), ("abc", "abc_2.jpg")}
    loose = {(r["doc"], r["file"]) for r in readers.pages_of_documents(docs, files, strict=False).collect()}
    assert loose == strict | {("ab", "abc_2.jpg")}
    assert [r[0] for r in files.select(readers.page_number(F.col("file"))).collect()] == [1, 10, 2]


def test_leaves_and_metrics(spark, tmp_path):
    for leaf, full in (("run/d/zeroshot_ocr", True), ("run/d/fewshot_ocr", False), ("latest/d/zeroshot_ocr", True)):
        put(tmp_path / leaf / "manifest.json", {"run_id": "run", "dataset": "d", "counts": {"n": 3}})
        if full:
            put(tmp_path / leaf / "predictions.json", {})
    found = readers.leaves(spark, str(tmp_path)).collect()
    assert [r["leaf"].rsplit("/", 1)[1] for r in found] == ["zeroshot_ocr"] and found[0]["counts"] == {"n": 3}
    path = put(tmp_path / "m.csv", "index,A,B\nx,0.5,1\ny,0.25,2\n")
    assert [tuple(r) for r in readers.metric_csv(spark, path, ["B"], ["y"]).collect()] == [("y", 2.0)]
    with pytest.raises(KeyError):
        readers.metric_csv(spark, path, ["C"])
    with pytest.raises(KeyError):
        readers.metric_csv(spark, path, rows=["z"])
    assert readers.metric_or_none(spark, str(tmp_path / "none.csv")) is None
    log = put(tmp_path / "log.jsonl", '{"current_steps": 1, "loss": 2.0}\n{"current_steps": 2, "loss": 1.0, "eval_loss": 3.0}\n{"current_steps": 3}\n')
    evaluation, training = readers.training_log(spark, log)
    assert [tuple(r) for r in evaluation.collect()] == [(2, 3.0)] and [tuple(r) for r in training.collect()] == [(1, 2.0)]


def test_cache_and_config(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "page string")
    cache = spark.createDataFrame([("a", "old"), ("b", None)], "page string, text string")
    got = readers.through_cache(wanted, cache, lambda df: df.withColumn("text", F.lit("new")), "page", "text")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "old"), ("b", "new")]
    assert readers.config("{bad")["complexity"] == 3 and readers.config('{"complexity": 2}')["complexity"] == 2
    with pytest.raises(ValueError):
        readers.config('{"dataset": {"type": "x"}}')


def test_image_sizes(spark):
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    png = head + b"\x08\x02\0\0\0" + struct.pack(">I", zlib.crc32(b""))
    df = spark.createDataFrame([("p", bytearray(png)), ("q", bytearray(b"no"))], "path string, content binary")
    assert [tuple(r) for r in readers.image_sizes(df).collect()] == [("p", 640, 480)]


def test_encoded_files_are_in_one_line(spark):
    import base64

    content = {"short": b"x", "long": bytes(range(256)), "none": None}
    rows = spark.createDataFrame(list(content.items()), "path string, content binary")
    assert dict(readers.encoded(rows).collect()) == {k: v if v is None else base64.b64encode(v).decode() for k, v in content.items()}


def test_standardize(spark):
    qa = json.dumps({"1": {"question": "q", "answers": [{"value": "v", "page": 3}]}, "2": {"question": "r", "answers": [{"value": "w", "page": "x"}]}})
    raw = spark.createDataFrame([("d", ["p"], "train", qa), ("e", ["p"], "train", "{bad")], "docId string, document array<string>, data_split string, qa string")
    got = standardize.standardize_flattened(standardize.flatten_documents(raw)).orderBy("questionId").collect()
    assert [(r["answers"], r["answer_page_idx"]) for r in got] == [(["v"], 2), (["w"], 0)]
    wide = spark.createDataFrame([("1", "q", "a", [3], "s1", None, "s10")], "questionId string, question string, answer string, evidence_pages array<int>, page_1 string, page_2 string, page_10 string")
    row = standardize.standardize_slides(standardize.long_pages(wide)).first()
    assert (row["document"], row["answer_page_idx"], row["answers"]) == (["s1", "s10"], 2, ["a"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "c", "d", "l", "m", "QUR", "overall", 0.5)], "run_id string, config string, dataset string, label string, model string, metric string, complexity string, value double")
    for _ in range(2):
        sinks.save_summary(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    sinks.save_comparison(rows.drop("label"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["run_id", *reports.SUMMARY_COLUMNS]
    assert "0.500" in sinks.latex(rows.select("metric", "value"))
    sinks.write_manifest(spark, str(tmp_path / "x/manifest.json"), {"a": 1})
    assert json.loads((tmp_path / "x/manifest.json").read_text()) == {"a": 1}
    sinks.update_latest(spark, str(tmp_path), "run_2")
    assert (tmp_path / "latest").read_text() == "run_2"
    assert sinks.finetune_manifest({"r": 16}, {"lora_rank": 8, "lora_alpha": 4}, None, None)["lora_rank"] == 16
    leaves = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b")], "run_id string, leaf string")
    assert sinks.sweep_manifest(leaves).first()["leaves"] == ["a", "b"]


def test_models(spark):
    df = spark.createDataFrame([(1, "corrupted", "abc"), (2, "clean", "de")], "qid long, side string, p string")
    assert [r["answer"] for r in models.evaluate(df, F.col("p"), ["corrupted"]).collect()] == ["mock answer 3"]
    objects = spark.createDataFrame([(1, "table"), (2, "figure"), (3, "title")], "i int, type string")
    describe = lambda d: d.withColumn("text", F.when(F.col("i") == 1, "ok").otherwise("Error: x"))
    got = models.route_text(objects, describe, lambda d: d.withColumn("text", F.lit("ocr")))
    assert {r["i"]: r["text"] for r in got.collect()} == {1: "ok", 2: "ocr", 3: "ocr"}


def test_stream_exact(spark, tmp_path):
    df = spark.range(50).withColumn("ok", F.col("id") % 3 == 0)
    for k in range(3):
        df.where(F.col("id") % 3 == k).union(df.where("id = 0")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = incremental.verified_until(source, lambda d: d.where("ok"), "id", 12, str(tmp_path / "state"))
    assert got.count() == 12 and got.select("id").distinct().count() == 12


def test_leaf_grid_and_git(tmp_path):
    from querent.functions import runs

    assert runs.resolve_leaf("r", "d", "s", "val", 3, "x", {}) == "r/eval_val_3_x/d/s"
    assert runs.resolve_leaf("r/", "d", "s", "val", 3, "x", {"RUN_ID": "run"}, "m") == "r/run/d/m__s"
    assert [c["few_shot"]["n_shots"] for c in runs.conditions(["a"])] == [2, 2, 4, 6]
    assert runs.git_state(str(tmp_path)) == ("unknown", False)


@pytest.mark.parametrize("dataset", ["MPDocVQA", "DUDE"])
def test_one_bad_file_among_many_is_told(spark, tmp_path, dataset):
    import json

    box = {"BoundingBox": {"Width": 0.5, "Height": 0.1, "Left": 0.2, "Top": 0.3}}
    line = {"Text": "a line", "Geometry": box, "BlockType": "LINE"}
    word = {"Text": "word", "Geometry": box, "BlockType": "WORD"}
    for i in range(12):
        whole = {"LINE": [line, {"Text": "no box"}, {"Geometry": box}, line]} if dataset == "MPDocVQA" else {"Blocks": [word, line, line]}
        (tmp_path / f"p_{i}.json").write_text(json.dumps([whole] if dataset == "DUDE" and i % 2 else whole, indent=1))
    (tmp_path / "p_20.json").write_text('{"LINE": [{"Text": "cut off", ')
    (tmp_path / "p_21.json").write_text("")
    (tmp_path / "p_22.json").write_text('{"other": 1}')
    (tmp_path / "p_23.json").write_text('{"LINE": [], "Blocks": []}')
    paths = [f"file://{tmp_path}/p_{i}.json" for i in (*range(12), 20, 21, 22, 23, 99)]
    rows = readers.ocr_or_error(spark, paths, dataset).collect()
    bad = {r["file"].rsplit("/", 1)[-1]: r["error"] for r in rows if r["error"]}
    assert bad == {"p_20.json": "no JSON of this kind", "p_21.json": "empty file", "p_22.json": "no LINE" if dataset == "MPDocVQA" else "no Blocks", "p_99.json": "no such file"}
    good = [r for r in rows if not r["error"]]
    plain = readers.ocr(spark, [p for p in paths if p.endswith(tuple(f"p_{i}.json" for i in range(12)))], dataset).collect()
    assert sorted((r["file"], r["ord"], r["text"], r["box"]) for r in good) == sorted((r["file"], r["ord"], r["text"], r["box"]) for r in plain) and len(good) == 24
    assert readers.ocr_or_error(spark, paths[-1], dataset).count() == 1
    with pytest.raises(ValueError):
        readers.ocr_or_error(spark, paths, "other")
