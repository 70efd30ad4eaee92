"""Array and text expressions against plain Python."""

import random
from itertools import combinations as combos
from itertools import product

import pytest
from pyspark.sql import functions as F

from querent.functions import runs, text, windows
from querent.operators import corruption, geometry


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def loop_windows(pages, w, s):
    if len(pages) <= w:
        return [pages] if pages else []
    out = []
    for start in range(0, len(pages), s):
        window = pages[start : start + w] if start + w <= len(pages) else pages[-w:]
        if window not in out:
            out.append(window)
        if start + w >= len(pages):
            break
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8])
def test_sliding_windows(spark, size):
    docs = [[f"p{i}" for i in range(n)] for n in range(0, 25)]
    step = 1 if size == 1 else max(1, size // 2)
    assert column(spark, docs, "array<string>", lambda c: windows.sliding_windows(c, size)) == [loop_windows(d, size, step) for d in docs]


def test_window_fixtures(spark):
    seven, ten, two = ([f"p{i}" for i in range(n)] for n in (7, 10, 2))
    starts = column(spark, [ten], "array<string>", lambda c: windows.sliding(c, 4))
    assert starts == [[0, 2, 4, 6]]
    assert column(spark, [two], "array<string>", lambda c: windows.sliding_windows(c, 3)) == [[two]]
    assert [len(w) for w in column(spark, [seven], "array<string>", lambda c: windows.tumbling_windows(c, 3))[0]] == [3, 3, 1]
    assert column(spark, [seven], "array<string>", lambda c: windows.anchor_window(c, F.lit("p6"), 3)) == [["p4", "p5", "p6"]]
    assert column(spark, [seven], "array<string>", lambda c: windows.anchor_window(c, F.lit("none"), 3)) == [["p0", "p1", "p2"]]


def test_replacements_cascade(spark):
    pairs = F.array(F.struct(F.lit("John").alias("text"), F.lit("Tesla").alias("replacement")), F.struct(F.lit("Tesla").alias("text"), F.lit("IBM").alias("replacement")))
    assert column(spark, ["Did John own Tesla?"], "string", lambda c: corruption.apply_replacements(c, pairs)) == ["Did IBM own IBM?"]


def test_corrupt_order_and_cap(spark):
    entities = spark.createDataFrame([(1, o, f"E{o}", "city") for o in range(3)], "qid long, ord int, text string, label string")
    pools = spark.createDataFrame([(1, o, f"E{o}", r, f"r{o}{r}") for o in range(3) for r in (1, 2, 3) if o < 2 or r < 2], "qid long, ord int, text string, rank int, replacement string")
    questions = spark.createDataFrame([(1, "E0 E1 E2")], "qid long, question string")
    got = corruption.corrupt(questions, entities, pools, complexity=3, samples=5).orderBy("complexity", "sample").collect()
    pool = {0: [1, 2, 3], 1: [1, 2, 3], 2: [1]}
    want = []
    for size in (1, 2, 3):
        made = [dict(zip(c, p)) for c in combos(range(3), size) for p in product(*(pool[o] for o in c))]
        want += [(size, " ".join(f"r{o}{m[o]}" if o in m else f"E{o}" for o in range(3))) for m in (made if size == 1 else made[:5])]
    assert [(r["complexity"], r["corrupted_question"]) for r in got] == want


def test_candidate_cap(spark):
    entities = spark.createDataFrame([(1, 0, "Rome", "city")], "qid long, ord int, text string, label string")
    texts = ["rome", "Oslo", "OSLO", "Bern", "Kyiv", "Lima", "Doha", "Riga", "Baku"]
    candidates = spark.createDataFrame([("city", i, t) for i, t in enumerate(texts)], "label string, cand_ord int, cand_text string")
    got = corruption.candidate_pools(entities, candidates, []).orderBy("rank").collect()
    assert [r["replacement"] for r in got] == ["Oslo", "Bern", "Kyiv", "Lima", "Doha"]


def greedy(boxes, share):
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    kept = []
    for b in sorted(boxes, key=lambda b: -area(b)):
        inter = lambda k: max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
        if not any(area(b) > 0 and inter(k) / area(b) >= share for k in kept):
            kept.append(b)
    return kept


def test_filter_boxes(spark):
    rng = random.Random(3)
    sets = [[[x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(0, 40), y + rng.randrange(0, 40)] for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    nested = [[0, 0, 100, 100], [10, 10, 60, 60], [20, 20, 30, 30]]
    chain = [[0, 0, 100, 100], [30, 0, 125, 100], [75, 0, 160, 100]]
    got = column(spark, [*sets, nested, chain], "array<array<int>>", lambda c: geometry.filter_boxes(c))
    assert got == [greedy(s, 0.6) for s in [*sets, nested, chain]]
    assert got[-2] == [nested[0]] and got[-1] == [chain[0], chain[2]]


def test_numbers_and_refusals(spark):
    numbers = {"$100": True, "$42": True, "5%": True, "3.": True, "1,000.5": True, "1d": False, "": False, "nan": True, "Paris": False, ".": False, "1e5": True, "€ 7": True}
    assert column(spark, list(numbers), "string", text.is_numeric) == list(numbers.values())
    refusals = {"Not available": True, "": True, " ": False, "$42": False, "I don't know it": True, "unable to determine.": True}
    assert column(spark, list(refusals), "string", text.refuses) == list(refusals.values())


def test_canonical_answers_call_the_classifier_once(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(["Not available", "", "$100", "Paris", None])], "i int, answer string")
    seen = []

    def classify(rest, column):
        seen.append([r[column] for r in rest.collect()])
        return rest.withColumn("classified", F.upper(column))

    got = {r["i"]: r["answer_converted"] for r in text.canonical_answers(df, classify=classify).collect()}
    assert got == {0: "unable to determine", 1: "unable to determine", 2: "$100", 3: "PARIS", 4: None} and seen == [["Paris"]]


def test_text_cleaning(spark):
    assert column(spark, ["  a\t b, (c)-d. - ", "été №1"], "string", text.clean_entity) == ["a b c-d.", "été 1"]
    assert column(spark, ['Question: "Who?".', "Rewritten question: Question: 'x'"], "string", text.clean_generated) == ['Who?"', "x"]
    long = "a" * 200 + ";" + "b" * 200
    assert column(spark, [["short", long, "c" * 800]], "array<string>", text.chunks) == [["short", "a" * 200 + ";", "b" * 200, "c" * 350, "c" * 350, "c" * 100]]
    assert column(spark, ['```json\n{"verification_result": "True"}\n```', "rubbish", None], "string", text.parse_verdict) == ["true", "false", "false"]


def test_prompt(spark):
    got = column(spark, ["Q?"], "string", lambda c: text.prompt(c, None, False))[0]
    assert got.endswith("- Base your answer solely on what you see in the image\nQuestion: Q?")
    both = column(spark, ["Q?"], "string", lambda c: text.prompt(c, F.lit("T"), False))[0]
    assert "following OCR text:\nT\n\nGuidelines:" in both and both.endswith("provided OCR text\n\nQuestion: Q?")


def test_run_names(spark):
    few = F.struct(F.lit(True).alias("enabled"), F.lit(2).alias("n_shots"), F.lit("mixed").alias("shot_type"), F.lit("random").alias("selection"))
    one = spark.range(1)
    name = lambda mode, ocr, w, f=None: one.select(runs.slug(F.lit(mode), F.lit(ocr), F.lit(w), f)).first()[0]
    assert name("finetuned", True, 1) == "finetuned_ocr"
    assert name("zeroshot", False, 1) == "zeroshot_noocr"
    assert name("fewshot", True, 2) == "fewshot_ocr_w2"
    assert name("fewshot", True, 1, few) == "fewshot_ocr_k2_mixed_random"
    assert name("zeroshot", True, 1, few) == "zeroshot_ocr"
    assert one.select(runs.run_id(F.lit("val"), F.lit(300), F.lit("2026-06-08 22:22:13").cast("timestamp"))).first()[0] == "eval_val_300_20260608_222213"


def test_reading_order(spark):
    objects = spark.createDataFrame([([([5, 9], "c"), ([1, 2], "b"), ([1, 2], "a"), ([0, 9], " ")],)], "o array<struct<BBOX:array<int>,OCR:string>>")
    assert objects.select(windows.reading_order(F.col("o"))).first()[0] == "a\nb\n \nc"
    assert objects.select(windows.verifier_order(F.col("o"))).first()[0] == "b\na\nc"


def test_nearest_category_of_more_than_ten_thousand(spark):
    """The last of the categories is the nearest one, however many there are."""
    from querent.operators.models import nearest_category

    examples = spark.range(10_050).selectExpr("cast(id as int) as label", "array(cos(id / 10050.0), sin(id / 10050.0)) as v")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert {r["id"]: r["label"] for r in nearest_category(asked, examples, "id", "v", "label").collect()} == {1: 10_049, 2: 0}
    assert [r["label"] for r in nearest_category(asked, examples.where("false"), "id", "v", "label").collect()] == [None, None]
