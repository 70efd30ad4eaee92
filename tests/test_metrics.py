"""Metrics on hand-made questions."""

from querent.model import DEFAULT_THRESHOLD, UNABLE, thresholds
from querent.operators import corruption, enrich, metrics, sampling, sft, verify


def values(df, *keys):
    return {tuple(r[k] for k in keys): (r["n"], r["hits"]) for r in df.collect()}


def frames(spark, questions, answers):
    return spark.createDataFrame(questions, "qid long, complexity int"), spark.createDataFrame(answers, "qid long, is_unable boolean")


def test_qur_and_frr(spark):
    q, a = frames(spark, [(1, 1), (2, 2), (3, 4), (4, 1)], [(1, True), (2, True), (2, True), (2, False), (3, True)])
    assert values(metrics.qur(q, a), "complexity") == {(0,): (4, 2), (1,): (2, 1), (2,): (1, 0), (3,): (0, 0)}
    assert values(metrics.ur(q, a), "complexity") == {(0,): (5, 4), (1,): (1, 1), (2,): (3, 2), (3,): (0, 0)}
    assert metrics.qur(q, a).where("complexity = 3").first()["value"] is None


def test_multiplicity(spark):
    q, a = frames(spark, [(1, 2)], [(1, True), (1, False)])
    entities = spark.createDataFrame([(1, "x", "table", 1), (1, "x", "figure", 2), (1, "y", "title", 3)], "qid long, text string, object_type string, ord int")
    unique = metrics.unique_entities(entities)
    assert {(r["text"], r["bucket"]) for r in unique.collect()} == {("x", "table"), ("y", "title")}
    macros = spark.createDataFrame([(1, "LOCATION"), (1, "LOCATION")], "qid long, bucket string")
    assert values(metrics.qur_by(q, a, macros), "bucket", "complexity") == {("LOCATION", 0): (2, 0), ("LOCATION", 2): (2, 0)}
    assert values(metrics.ur_by(q, a, macros), "bucket", "complexity")[("LOCATION", 0)] == (4, 2)
    assert len(values(metrics.qur_by(q, a, macros, buckets=("LOCATION", "ENTITY")), "bucket", "complexity")) == 8


def test_density_and_quadrant(spark):
    objects = [(1, "table")] * 3 + [(1, "title")] * 17 + [(2, "table")] + [(2, "title")] * 3
    df = spark.createDataFrame(objects, "qid long, layout_type string")
    assert {r["qid"]: r["bucket"] for r in metrics.density_slices(df).collect()} == {1: "15-25", 2: ">25"}
    from pyspark.sql import functions as F

    at = lambda x, y: spark.range(1).select(metrics.quadrant(F.lit(x), F.lit(y), F.lit(100.0), F.lit(100.0))).first()[0]
    assert (at(50.0, 0.0), at(49.0, 50.0), at(0.0, 0.0), at(51.0, 99.0)) == ("TOP_RIGHT", "BOTTOM_LEFT", "TOP_LEFT", "BOTTOM_RIGHT")


def test_unable_is_exact(spark):
    df = spark.createDataFrame([(UNABLE.title(),), (UNABLE + ".",), (None,)], "c string")
    assert [r[0] for r in df.select(metrics.is_unable(df["c"])).collect()] == [True, False, False]


def test_in_page(spark):
    answers = spark.createDataFrame([(1, 0, "a", True), (1, 0, "b", True), (1, 1, "c", False)], "qid long, win int, page string, is_unable boolean")
    patches = spark.createDataFrame([(1, "b", "X"), (1, "c", "x")], "qid long, page string, text string")
    wrong = spark.createDataFrame([(1, "X")], "qid long, text string")
    assert {r["win"]: r["in_page"] for r in metrics.in_page(answers, patches, wrong).collect()} == {0: True, 1: False}


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([("city", 0.75), ("city", 0.76), ("job_title_name", 0.9), ("job_title_name", 0.91), ("city", None)], "label string, score double")
    got = corruption.passes_threshold(df, thresholds(spark), DEFAULT_THRESHOLD)
    assert sorted((r["label"], r["score"]) for r in got.collect()) == [("city", 0.76), ("job_title_name", 0.91)]


def test_removal(spark):
    df = spark.createDataFrame([("A", "a"), ("b\nuser x", "a"), ("c", "a")], "corrupted_question string, original_question string")
    assert tuple(corruption.removal_counts(df).first()) == (3, 1, 1, 1)


def test_positions_fall_back_to_all_pages(spark):
    entities = spark.createDataFrame([(1, 0, "Rome", "p1"), (1, 1, "Oslo", "p1"), (1, 2, "none", "p1")], "qid long, ord int, text string, page_id string")
    patches = spark.createDataFrame([(1, "p1", 0, 0, 0, "rome ", "city"), (1, "p2", 1, 0, 0, "Rome", "city"), (1, "p2", 1, 1, 0, "Oslo", "city")], "qid long, page_id string, page_ord int, obj_ord int, ent_ord int, text string, label string")
    got = {r["ord"]: [p["on_page"] for p in r["positions"]] for r in enrich.positions(entities, patches).collect()}
    assert got == {0: ["p1"], 1: ["p2"], 2: []}


def test_question_entities(spark):
    kinds = "qid long, ord int, text string, label string"
    listed = spark.createDataFrame([(1, 0, "rome", None), (1, 1, "Oslo", None), (1, 2, "Bern", None), (1, 3, "?", None)], kinds)
    known = spark.createDataFrame([("Rome", "city")], "text string, label string")
    own = spark.createDataFrame([(1, 0, "oslo", "town")], kinds)
    wrong = spark.createDataFrame([(1, 0, "bern", "place")], kinds)
    got = {r["ord"]: (r["label"], r["source"]) for r in enrich.question_entities(listed, known, own, wrong).collect()}
    assert got == {0: ("city", "global"), 1: ("town", "original"), 2: ("place", "corrupted"), 3: (None, "none")}


def test_adjacent_pages_and_verdict(spark):
    pages = spark.createDataFrame([(1, p, p == "p10") for p in ("p0", "p1", "p10", "p2", "p3")], "qid long, page_id string, hit boolean")
    assert sorted(r["page_id"] for r in verify.adjacent_pages(pages).collect()) == ["p1", "p10", "p2"]
    assert sorted(r["page_id"] for r in verify.adjacent_pages(pages, natural_order=True).collect()) == ["p10", "p3"]
    judged = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "d", None), (2, 1, "e", False)], "qid long, page_ord int, image_path string, answerable boolean")
    assert {r["qid"]: tuple(r)[1:] for r in verify.any_page_answers(judged).collect()} == {1: ("true", "b"), 2: ("False", "e")}


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "qid")
    first = [r[0] for r in sampling.sample_range(df, "qid", 10).collect()]
    assert first == [r[0] for r in sampling.sample_range(df.repartition(7), "qid", 10).collect()] and len(set(first)) == 10
    assert sampling.sample_range(df, "qid", 10, offset=95).count() == 5
    assert sampling.sample_percent(df, "qid", 12.9).count() == 12
    assert sum(sampling.shard(df, "qid", r, 3).count() for r in range(3)) == 100
    assert sampling.few_shot_roles(1, "mixed") == ["unanswerable"] and sampling.few_shot_roles(3, "mixed").count("answerable") == 1
    used = spark.createDataFrame([("a",), (None,)], "question string")
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "question string")
    assert sorted(str(r[0]) for r in sampling.exclude_used(rows, used).collect()) == ["None", "b", "b"]


def test_few_shot_specific_by_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 4), rng.sample("abcde", rng.randrange(0, 4))) for i in range(60)]
    q = spark.createDataFrame(rows, "qid long, complexity int, types array<string>")
    pool = spark.createDataFrame([(*r, 100 - r[0]) for r in rows[:25]], "qid long, complexity int, types array<string>, pool_ord long")
    got = {}
    for r in sampling.few_shot_specific(q, pool, 3).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["pool_id"])
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    for i, c, t in rows:
        order = sorted((p for p in rows[:25] if p[0] != i), key=lambda p: (p[1] != c, -jac(t, p[2]), 100 - p[0]))
        assert got[i] == [p[0] for p in order[:3]]


def test_sft(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in sft.next_answers(turns).collect()] == [(1, 0, "q", "a")]
    kinds = spark.createDataFrame([("d", "clean"), ("d", "corrupted"), ("e", "clean")], "dataset string, kind string")
    assert {r["dataset"]: tuple(r)[1:4] for r in sft.recap(kinds).collect()} == {"d": (1, 1, 2), "e": (1, 0, 1), None: (2, 1, 3)}
    from pyspark.sql import functions as F

    one = spark.range(1).select(sft.truncated(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [-100, -100, 3])), 2, 9).alias("t")).first()["t"]
    assert one["ids"] == [1, 2] and one["labels"] == [-100, 9]
