"""The pipeline by its stages, each against a plain version on what the stage before it kept."""

import zlib

import numpy as np

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querent.llm import mixing, quality_rules, queries, simhash
from tests_llm_helpers import base_secrets, ids_of, keep_first_of_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, states[-1], SF)
        out.write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert states[-1].columns == columns
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states[:-1]]

    model = quality_rules.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = quality_rules.judge([r["text"] for r in rows[0].values()], model)[3]
    assert set(rows[1]) == {i for i, k in zip(rows[0], kept) if k}

    texts = {i: r["text"] for i, r in rows[1].items()}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    assert set(rows[2]) == keep_first_of_components({i: simhash.fingerprint(t) for i, t in texts.items()}, sets)

    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        assert not base_secrets(r["text"]) and len(r["text"]) == r["n_chars"]
        if not base_secrets(rows[2][i]["text"]) and "[SECRET]" not in r["text"]:
            assert r == rows[2][i]

    mixed = {r["doc_id"]: r["kept"] for r in mixing.mix(states[3]).collect()}
    assert set(rows[4]) == {i for i, k in mixed.items() if k} and all(rows[4][i] == rows[3][i] for i in rows[4])

    pieces = states[5].collect()
    whole = dict(zip(rows[4], ids_of("byte_bpe_50k.json", [r["text"] for r in rows[4].values()], 1)))
    assert {p["doc_id"] for p in pieces} == set(whole) and sum(p["length"] for p in pieces) == sum(map(len, whole.values()))
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(whole[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[0] == "doc_id" and queries.ORACLE.get("pipeline") is None


@pytest.fixture(scope="module")
def odd(spark):
    """documents with nulls in any column, empty and very long texts, repeated rows and columns whose names clash with the stages'."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    texts = [None, "", " \n", "one two", "wort " * 40_000, "password: hunter2hunter2 " * 3]
    rows = [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(2000, texts[4], None, None, None), (None, texts[5], None, "s", None), (2001, None, None, None, None), (2001, None, None, None, None)]
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.where("doc_id < 5"))
    for c in ("score", "kept", "fp", "sid", "topic", "tokens", "weight", "label_", "token"):
        every = every.withColumn(c, F.lit(c))
    return every.cache()


@pytest.mark.parametrize("place", range(5))
def test_stage_on_odd_rows(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd, SF)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    else:
        assert out.columns == odd.columns and 0 < len(rows) <= odd.count()
        assert all(r["topic"] == "topic" and r["token"] == "token" for r in rows)
    if name == "quality_rules":
        assert all(r["text"] and len(r["text"].split()) >= 50 for r in rows)
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] >= 1000) == [1000, 1003, 1004, 1005]
    if name == "secrets":
        assert len(rows) == odd.count() and sum(r["text"] is None and r["n_chars"] is None for r in rows) == 3 and not any("hunter2" in (r["text"] or "") for r in rows)
    assert stage(spark, odd.where("false"), SF).count() == 0


@pytest.mark.parametrize("place", range(1, 5))
def test_stage_without_any_word(spark, odd, place):
    """No text has a word: no stage fails, near-duplicates keep one, secrets and packing keep all."""
    none = odd.where("doc_id in (1000, 1001, 1002, 2001)")
    out = corpus_pipeline.STAGES[place][1](spark, none, SF).count()
    assert out == {1: 1, 2: 5}.get(place, out) and (place != 4 or out >= 5)


def test_run_leaves_only_its_last_input(spark, tmp_path, monkeypatch):
    from querent.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["mixing"]
