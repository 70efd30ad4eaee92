"""What has no limit any more, what is refused, and what must not fail on odd inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.operators import corruption, enrich, metrics, models, reports, sampling, sft, standardize, verify
from querent.sources import readers, sinks


def test_pages_of_documents_of_many_lengths(spark):
    """Ids of every length from 1 on, each the beginning of the next one's file."""
    docs = spark.createDataFrame([("a" * n,) for n in range(1, 300)], "doc string")
    files = spark.createDataFrame([("a" * 299 + "_1.jpg",), ("b_1.jpg",)], "file string")
    assert readers.pages_of_documents(docs, files, strict=False).count() == 299


def test_latex_refuses_long_tables(spark):
    rows = spark.range(30).select((F.col("id") / 8).alias("v"))
    assert sinks.latex(rows, most=30).count("\\\\") == 31
    with pytest.raises(ValueError):
        sinks.latex(rows, most=29)
    assert sinks.latex(spark.createDataFrame([(None, 1.0)], "a string, b double")).split("\n")[2] == " & 1.000 \\\\"


def test_empty_tables_have_no_rates(spark):
    assert tuple(metrics.run_counters(spark.createDataFrame([], "is_error boolean")).first()) == (0, 0, 0, None)
    assert tuple(metrics.answer_accuracy(spark.createDataFrame([], "answer string, expected string")).first()) == (0, None)
    assert sft.recap(spark.createDataFrame([], "dataset string, kind string")).count() == 0


def test_nearest_category_of_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], 5), (2, [1.0, 0.0], 6), (3, [0.0, 2.0], 7), (4, [-1.0, -1.0], 8)], "id long, v array<double>, c int")
    got = {r["id"]: r["c"] for r in models.nearest_category(rows, rows, "id", "v", "c").collect()}
    assert got == {1: 5, 2: 6, 3: 7, 4: 8}
    cos = rows.select(models.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(0.0))).alias("x")).collect()
    assert [round(r["x"], 6) for r in cos] == [0.0, 1.0, 0.0, -0.707107]


def test_sample_by_the_cut_equals_the_sort(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "qid")
    ranked = [r["qid"] for r in df.orderBy(sampling.shuffled("qid"), "qid").collect()]
    monkeypatch.setattr(sampling, "TOP", 50)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    for n, offset in ((2000, 0), (700, 900), (5000, 10), (100, 2950), (10, 4000), (3000, 0)):
        assert sorted(r["qid"] for r in sampling.sample_range(df, "qid", n, offset).collect()) == sorted(ranked[offset : offset + n])
    assert [r["qid"] for r in sampling.sample_percent(df, "qid", 50, shuffle=True).collect()] == ranked[:1500]
    assert [r["qid"] for r in sampling.sample_percent(df, "qid", 100, shuffle=True).collect()] == ranked
    numbered = {r["pool_id"]: r["at"] for r in sampling.numbered(df.select(F.col("qid").alias("pool_id"), sampling.shuffled("qid").alias("h")), 3000).collect()}
    assert numbered == {q: i for i, q in enumerate(ranked)}
    assert sum(sampling.shard(df, "qid", i, 3).count() for i in range(3)) == 3000


def test_samples_of_repeated_ids_do_not_depend_on_their_size(spark, monkeypatch):
    rows = [(i % 4, f"t{i % 29}", None if i % 3 else i % 7) for i in range(120)] + [(None, "x", 1)] * 5
    df = spark.createDataFrame(rows, "qid long, text string, n int").repartition(3)
    key = lambda r: (str(r["qid"]), r["text"], str(r["n"]))
    few = {(n, offset): sorted(map(key, sampling.sample_range(df, "qid", n, offset).collect())) for n, offset in ((15, 0), (40, 0), (30, 25), (60, 110), (3, 124), (5, 200), (0, 3), (1, 40))}
    monkeypatch.setattr(sampling, "TOP", 2)
    monkeypatch.setattr(sampling, "DIGITS", 16)
    for (n, offset), want in few.items():
        assert len(want) == max(0, min(n, 125 - offset))
        assert sorted(map(key, sampling.sample_range(df, "qid", n, offset).collect())) == want


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


@pytest.mark.parametrize("content", [None, "same"])
def test_few_shot_specific_of_a_large_pool(spark, content):
    rng = random.Random(3)
    kinds = [[], ["a"], ["b"], ["a", "b"], ["c", "d", "e"], ["e"], ["x"]]
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(kinds), i % 9) for i in range(150)]
    own = spark.createDataFrame(rows, "qid long, complexity int, types array<string>, same int").where("complexity is not null")
    pool = own.withColumn("pool_ord", F.col("qid"))
    got = {}
    for r in sampling.few_shot_specific(own, pool, 3, content).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["pool_id"]))
    rows = [r for r in rows if r[1] is not None]
    for q in rows:
        others = [p for p in rows if (p[3] != q[3] if content else p[0] != q[0])]
        best = sorted(others, key=lambda p: (-(p[1] == q[1]), -jaccard(p[2], q[2]), p[0]))[:3]
        assert [i for _, i in sorted(got[q[0]])] == [p[0] for p in best]


def test_select_few_shot(spark):
    pool = spark.createDataFrame([(i, 20 - i, 1, ["a"]) for i in range(5)], "qid long, pool_ord int, complexity int, types array<string>")
    questions = spark.createDataFrame([(i, 1, ["a"]) for i in range(40)], "qid long, complexity int, types array<string>")
    picked = sampling.select_few_shot(questions, pool, 3, "handpicked").collect()
    assert {r["role"] for r in picked} == {"answerable"}
    assert [r["pool_id"] for r in sorted(picked, key=lambda r: r["place"]) if r["qid"] == 4] == [3, 2, 1] and [r["pool_id"] for r in sorted(picked, key=lambda r: r["place"]) if r["qid"] == 30] == [4, 3, 2]
    mixed = sampling.select_few_shot(questions, pool, 3, "random", "mixed").collect()
    assert Counter(Counter(r["role"] for r in mixed).items()) == Counter({("answerable", 40): 1, ("unanswerable", 80): 1})
    assert all(r["qid"] != r["pool_id"] for r in mixed) and len({(r["qid"], r["pool_id"]) for r in mixed}) == 120
    assert len({tuple(r["role"] for r in sorted((x for x in mixed if x["qid"] == q), key=lambda x: x["place"])) for q in range(40)}) == 3  # shuffled
    assert sampling.select_few_shot(questions, pool, 9, "random").where("qid = 0").count() == 4  # no more than there are
    assert sampling.select_few_shot(questions, pool.where("false"), 2, "handpicked").count() == 0
    assert sampling.select_few_shot(questions, pool.where("false"), 2, "random").count() == 0
    specific = sampling.select_few_shot(questions, pool, 2, "specific", "answerable").where("qid = 7").orderBy("place").collect()
    assert [(r["place"], r["pool_id"], r["role"]) for r in specific] == [(1, 4, "answerable"), (2, 3, "answerable")]


def test_corrupt_with_many_entities(spark):
    """A question with 200 entities: only combinations that can count are made."""
    entities = spark.createDataFrame([(1, i, f"e{i:03}", "L") for i in range(200)], "qid long, ord int, text string, label string")
    pools = spark.createDataFrame([(1, i, f"e{i:03}", r, f"r{i}_{r}") for i in range(1, 200, 2) for r in (1, 2)], "qid long, ord int, text string, rank int, replacement string")
    got = corruption.corrupt(spark.createDataFrame([(1, "e001 e003 e005")], "qid long, question string"), entities, pools)
    rows = got.collect()
    assert Counter(r["complexity"] for r in rows) == {1: 200, 2: 5, 3: 5}
    pairs = {(r["complexity"], r["sample"]): [p["replacement"] for p in r["pairs"]] for r in rows}
    assert pairs[2, 1] == ["r1_1", "r3_1"] and pairs[2, 4] == ["r1_2", "r3_2"] and pairs[2, 5] == ["r1_1", "r5_1"]
    assert pairs[3, 5] == ["r1_2", "r3_1", "r5_1"]


def test_flatten_documents(spark):
    qa = '{"a": {"question": "one?", "answers": ["x", 7, {"value": "y", "page": 3}, {"value": "z", "page": "p"}]}, "b": {"question": "due?", "answers": []}}'
    raw = spark.createDataFrame([(1, "d", qa), (2, "e", "{bad"), (3, "f", qa), (4, "g", None)], "n int, docId string, qa string")
    out = standardize.flatten_documents(raw).orderBy("n", "questionId").collect()
    assert [(r["docId"], r["questionId"]) for r in out] == [("d", "a"), ("d", "b"), ("f", "a"), ("f", "b")]
    assert [(a["value"], a["page"]) for a in out[0]["answers"]] == [("x", 0), ("7", 0), ("y", 2), ("z", 0)]
    english = lambda q: F.when(q == "one?", "en").otherwise("it")
    assert [r["docId"] for r in standardize.flatten_documents(raw, english, order="n", skip=1, most=5).collect()] == ["f"]


def test_suite_on_windows_of_several_pages(spark):
    """Types count once a window, quadrants once an object, visual objects on all pages of the window; questions without answers count."""
    q = spark.createDataFrame([(1, 1), (2, 4), (3, 2)], "qid long, complexity int")
    w = spark.createDataFrame([(1, ["p", "q"], True), (1, ["r"], True), (2, ["p"], False)], "qid long, pages array<string>, is_unable boolean")
    e = spark.createDataFrame([(1, 0, "x", "table", "NUMERIC", "TOP_LEFT"), (1, 1, "x", "title", "NUMERIC", "TOP_LEFT")], "qid long, ord int, text string, object_type string, macro string, quadrant string")
    patches = spark.createDataFrame([(1, "p", 1, "x", "table", "TOP_LEFT"), (1, "q", 2, "x", "table", "TOP_LEFT"), (1, "q", 2, "x", "table", "TOP_LEFT"), (1, "r", 3, "X", "title", "TOP_LEFT")],
                                    "qid long, page string, obj int, text string, object_type string, quadrant string")
    objects = spark.createDataFrame([(1, "p", "table"), (1, "q", "table"), (1, "r", "title")], "qid long, page string, layout_type string")
    got = {(r["metric"], r["bucket"], r["complexity"]): (r["n"], r["hits"]) for r in metrics.metric_suite(q, w, e, patches, objects).collect()}
    assert got["QUR", None, 0] == (3, 1) and got["QUR", None, 1] == (1, 1) and got["QUR", None, 3] == (0, 0) and ("QUR", None, 4) not in got
    assert got["UR", None, 0] == (3, 2) and got["UR_PAGE_DE", "table", 0] == (1, 1) and got["UR_PAGE_QP", "TOP_LEFT", 0] == (2, 2)
    assert got["UR_PAGE", "true", 0] == (1, 1) and got["UR_PAGE", "false", 0] == (2, 1)
    assert got["UR_PAGE_DED", ">1", 0] == (1, 1) and got["UR_PAGE_DED", "0", 0] == (2, 1)
    assert got["QUR_DE", "table", 0] == (1, 1) and got["QUR_DE", "title", 0] == (0, 0) and got["QUR_QP", "TOP_LEFT", 0] == (2, 2) and got["UR_NLPE", "NUMERIC", 1] == (4, 4)
    assert got["QUR_PL", "3", 0] == (1, 1) and got["QUR_PL", "0", 0] == (1, 0) and got["QUR_DED", ">25", 1] == (1, 1) and got["QUR_DED", "<15", 0] == (2, 0)


def test_question_entities_of_any_form(spark):
    questions = spark.createDataFrame([(1, [(0, "Rome"), (1, " ")], None), (2, None, " Rome,, Oslo "), (3, None, None)], "qid long, listed array<struct<ord:int,text:string>>, written string")
    known = spark.createDataFrame([("rome", "city")], "text string, label string")
    originals = spark.createDataFrame([(1, 0, "x", "l"), (3, 4, "Paris", "city"), (3, 5, " ", "city"), (2, 0, "Oslo", "city")], "qid long, ord int, text string, label string")
    got = sorted(tuple(r) for r in enrich.question_entities_of_any_form(questions, known, originals, originals).fillna("-").collect())
    assert got == [(1, 0, "rome", "city", "global"), (1, 1, " ", "-", "none"), (2, 0, "rome", "city", "global"), (2, 1, "Oslo", "-", "none"), (3, 4, "Paris", "city", "original")]


def test_candidate_occurrences(spark):
    entities = spark.createDataFrame([(1, 0, "Rome", "city")], "qid long, ord int, text string, label string")
    place = [(1, 0, 0, 0, "city", "ROME", "p"), (1, 0, 0, 1, "city", "Oslo", "p"), (1, 0, 0, 2, "city", "Oslo", "p"), (1, 0, 1, 0, "city", "oslo", "p"), (1, 1, 0, 0, "city", "Bern", "q"), (1, 1, 0, 1, "food", "Pie", "q")]
    patches = spark.createDataFrame(place, "qid long, page_ord int, obj_ord int, ent_ord int, label string, text string, page_id string").select(
        "*", F.concat(F.lit("o"), F.col("obj_ord").cast("string")).alias("obj_id"), F.array(F.lit(1)).alias("bbox"), F.lit("t").alias("layout_type"), F.lit("t1").alias("layout_type_id"))
    got = [(r["rank"], r["low"], [(p["text"], p["obj_id"]) for p in r["places"]]) for r in corruption.occurrences(entities, patches).orderBy("rank").collect()]
    assert got == [(1, "oslo", [("Oslo", "o0_entity_0"), ("oslo", "o1_entity_2")]), (2, "bern", [("Bern", "o0_entity_3")])]
    assert corruption.gated(entities, spark.createDataFrame([(2,)], "qid long")).count() == 0


def test_report_frames(spark):
    rows = spark.createDataFrame([("d", "zeroshot", 0.5), ("d", "finetuned", 0.8), ("e", "zeroshot", 0.1), ("f", "zeroshot", 0.3), ("f", "finetuned", 1.0)], "dataset string, strategy string, value double").withColumn("model", F.lit("m"))
    got = reports.macro_headroom(rows, ["model"]).first()
    assert (round(got["before"], 6), round(got["after"], 6), round(got["gain"], 6)) == (0.4, 0.9, round(0.5 / 0.6, 6))
    pairs = spark.createDataFrame([("m", "finetuned", 0.2, 0.4), ("m", "finetuned", None, 1.0), ("m", "zeroshot", 0.9, 0.9)], "model string, strategy string, frr double, qur double")
    assert [tuple(r) for r in reports.model_means(pairs).collect()] == [("m", 0.2, 0.4)]
    levels = lambda c3: spark.createDataFrame([("d", c, v) for c, v in enumerate((0.5, 0.4, 0.3, c3))], "dataset string, complexity int, value double")
    assert [r["QUR_C3"] for r in reports.tuned_frame(levels(0.0), levels(0.7)).collect()] == [None] and reports.tuned_frame(levels(0.0), levels(0.7)).first()["FRR_C3"] is None
    assert reports.tuned_frame(levels(0.2), levels(0.7)).first()["FRR_C3"] == 0.7


def test_skip_without_images(spark):
    questions = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "qid long, pages array<string>")
    kept, counted = verify.skip_without_images(questions, "pages", spark.createDataFrame([("a",)], "path string"))
    assert sorted(r["qid"] for r in kept.collect()) == [2, 3] and tuple(counted.first()) == (3, 1)


def test_rewriting(spark):
    df = spark.createDataFrame([("o", "c", [("x",), ("x",), ("y",)])], "original_question string, corrupted_question string, corrupted_entities array<struct<text:string>>")
    got = models.rewrite_questions(df, lambda prompts: [f'Rewritten question: "{len(p)}."' for p in prompts]).first()
    assert got["entities"] == ["x", "y"] and got["rewritten"].strip('."').isdigit() and "x, y" in got["prompt"]


def plain_nearest(v, means, least=None):
    import numpy as np

    if v is None or None in v or len(v) != len(next(iter(means.values()))):
        return min(means) if least is None else -1
    n = np.linalg.norm(v)
    scores = {c: float(np.dot(v, m) / n) if n else 0.0 for c, m in means.items()}
    best = max(scores.values())
    c = min(c for c, s in scores.items() if abs(s - best) < 1e-12)
    return c if least is None or best >= least else -1


@pytest.mark.parametrize("block", [4096, 30])
def test_nearest_of_many_categories(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(models, "BLOCK", block)
    monkeypatch.setattr(models, "AT_ONCE", 16)
    monkeypatch.setattr(models, "SHARE", 50)
    rng = np.random.default_rng(2)
    examples = [(int(c), rng.normal(0, 1, 8).tolist()) for c in range(200) for _ in range(1 + c % 3)] + [(500, [0.0] * 8)]
    rows = [(i, rng.normal(0, 1, 8).tolist(), 3) for i in range(120)] + [(200, None, 3), (201, [0.0] * 8, 3), (202, [1.0, None] * 4, 3), (203, [1.0], 3)]
    rows += [rows[0]] * 70 + [(None, rows[1][1], 3)]
    q = spark.createDataFrame(rows, "id long, v array<double>, other int").repartition(3)
    e = spark.createDataFrame(examples, "c int, v array<double>").repartition(3)
    unit = {}
    for c, v in examples:
        n = np.linalg.norm(v)
        unit.setdefault(c, []).append(np.array(v) / n if n else np.zeros(8))
    means = {c: np.mean(vs, axis=0) for c, vs in unit.items()}
    for least in (None, 0.6):
        got = sorted(((r["id"], r["c"]) for r in models.nearest_category(q, e, "id", "v", "c", least).collect()), key=str)
        assert got == sorted(((i, plain_nearest(v, means, least)) for i, v, _ in rows), key=str)
    none = models.nearest_category(q, e.limit(0), "id", "v", "c").collect()
    assert len(none) == len(rows) and all(r["c"] is None for r in none)


def test_numbers_by_ranges(spark):
    from querent.operators.ranges import numbered

    rows = [(i % 7, f"t{i % 50}", None if i % 4 else i) for i in range(300)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "k int, text string, n int").repartition(5)
    got = numbered(df, ["k", "text"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(303))
    assert [(r["k"] is not None, r["k"] or 0, r["text"] or "") for r in got] == sorted((k is not None, k or 0, t or "") for k, t, _ in rows)
    assert numbered(df.limit(0), ["k"], "at").count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_few_shot_of_many_complexities(spark, k):
    """Examples that share no type come by pool order, of the question's complexity and of the others."""
    rng = random.Random(k)
    rows = [(i, rng.randrange(9), rng.choice([[], ["a"], ["b"], ["x", "y"]]), rng.choice([1, 1, 1, 2, 3])) for i in range(90)]
    own = spark.createDataFrame(rows, "qid long, complexity int, types array<string>, same int")
    got = {}
    for r in sampling.few_shot_specific(own, own.withColumn("pool_ord", F.col("qid")), k, "same").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["pool_id"]))
    for q in rows:
        best = sorted((p for p in rows if p[3] != q[3]), key=lambda p: (-(p[1] == q[1]), -jaccard(p[2], q[2]), p[0]))[:k]
        assert [i for _, i in sorted(got.get(q[0], []))] == [p[0] for p in best]


def test_answers_of_crowded_pages_come_in_shares(spark, monkeypatch):
    monkeypatch.setattr(corruption, "PAIRS", 50)
    texts, asked = ["red bolt", "Red_ ring", "old nut", None], ["red_", "RED", "nut", "", None, "zinc"]
    objects = spark.createDataFrame([(p, i, texts[i % 4]) for p in (1, 2, None) for i in range(40)], "page int, obj_ord int, text string")
    answers = spark.createDataFrame([(i, p, i, asked[i % 6]) for p in (2, 3, None) for i in range(30)], "qid int, page int, ans_ord int, answer string")
    form = lambda x: x.lower().replace(" ", "").replace("_", "")
    wanted = [(2, i, texts[i % 4], j, j, asked[j % 6]) for i in range(40) for j in range(30) if None not in (texts[i % 4], asked[j % 6]) and form(asked[j % 6]) in form(texts[i % 4])]
    found = corruption.answer_locations(objects, answers)
    assert found.columns == ["page", "obj_ord", "text", "qid", "ans_ord", "answer"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_pools_in_one_row_an_entity_give_the_same_variants(spark):
    entities = spark.createDataFrame([(q, o, f"t{(q + o) % 4}", "l" if o < 4 else "none") for q in range(5) for o in range(q + 1)], "qid int, ord int, text string, label string")
    candidates = spark.createDataFrame([("l", i, f"T{i % 7}") for i in range(20)] + [("other", 0, "x")], "label string, cand_ord int, cand_text string")
    questions = spark.createDataFrame([(q, "t0 t1 t2 t3") for q in range(5)], "qid int, question string")
    rows = lambda pools: sorted(map(str, corruption.corrupt(questions, entities, pools, complexity=3).collect()))
    held = corruption.entity_pools(entities, candidates, [])
    assert rows(held) == rows(corruption.candidate_pools(entities, candidates, []))
    assert held.count() == entities.where("label = 'l'").count() and set(map(len, (r["replacements"] for r in held.collect()))) == {5}


def test_analyse_pages_goes_over_the_documents_once_for_its_rows(spark):
    documents = spark.createDataFrame([(1, ["a", "b", None, "a"]), (2, ["c", "gone", "d"]), (3, []), (4, None)], "qid long, document array<string>")
    images = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("unused",)], "path string")
    cache = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None), ("gone", ["y"])], "path string, objects array<string>")
    out = models.analyse_pages(documents, images, cache, lambda df: df.select("path", F.array(F.lit("found")).alias("objects")))
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a", ["x"]), (1, 3, "a", ["x"]), (2, 0, "c", ["found"]), (2, 2, "d", ["found"])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_rows_of_crowded_pages_go_to_few_shares(spark, monkeypatch, tmp_path):
    """Of n objects and n answers with one form, in shares of p pairs, some n * n / sqrt(p) rows are shuffled, not n * n * n / p."""
    objects = spark.createDataFrame([(1, i, "red bolt") for i in range(400)], "page int, obj_ord long, text string")
    answers = spark.createDataFrame([(1000 + i, 1, 0, "red_") for i in range(400)], "qid long, page int, ans_ord int, answer string")
    everything = {(q, i) for q in range(1000, 1400) for i in range(400)}

    def shuffled(node) -> int:
        below = node.children()
        own = node.metrics().get("shuffleRecordsWritten").get().value() if node.nodeName() == "Exchange" else 0
        return own + sum(shuffled(below.apply(i)) for i in range(below.size()))

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(corruption, "PAIRS", 400)
        found = corruption.answer_locations(objects, answers).select("qid", "obj_ord")
        got = found.collect()
        assert len(got) == len(everything) and set(map(tuple, got)) == everything
        assert shuffled(found._jdf.queryExecution().executedPlan()) < 400 * 400 / 20 * 2 * 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    monkeypatch.setattr(corruption, "PAIRS", 1 << 20)
    corruption.answer_locations(objects, answers).select("qid", "obj_ord").write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(*map(str, files)).distinct().count() == len(everything) and sum(f.stat().st_size for f in files) < len(everything) / 3
