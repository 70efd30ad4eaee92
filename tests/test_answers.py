"""Answers within texts, against a search for each of them."""

import random
import re

from pyspark.sql import functions as F

from querent.operators import answers


def form(s):
    return re.sub(r"[\s_]+", "", s).lower()


def brute(texts, wanted):
    out = set()
    for t in {form(t) for t in texts if t}:
        for a in {form(a) for a in wanted if a} - {""}:
            places = tuple(i for i in range(len(t) - len(a) + 1) if t.startswith(a, i))
            if places:
                out.add((t, a, places))
    return out


def found(spark, texts, wanted):
    left = spark.createDataFrame([(t, 1) for t in texts], "text string, answer int")
    right = spark.createDataFrame([(a, 1) for a in wanted], "answer string, text int")
    got = answers.answers_in_texts(left, right).collect()
    assert len(got) == len({(r["text_key"], r["answer_key"]) for r in got})
    name = {r["k"]: form(r["t"]) for df, c in ((left, "text"), (right, "answer")) for r in df.where(f"{c} is not null").select(answers.key_of(F.col(c)).alias("k"), F.col(c).alias("t")).collect()}
    return {(name[r["text_key"]], name[r["answer_key"]], tuple(r["places"])) for r in got}


def test_short_answers_and_underscores(spark):
    texts = ["So alpha beta gamma and delta epsilon zeta eta theta iota end", "ALPHA_BETA  gamma", None, "", "aaaa", "x"]
    wanted = ["alpha beta gamma", "delta epsilon zeta eta theta iota", "alpha_beta", "a", "aa", None, "", " _ ", "beta gamma", "missing", "X"]
    assert found(spark, texts, wanted) == brute(texts, wanted)


def test_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(answers, "BLOCK_CHARS", 60)
    monkeypatch.setattr(answers, "SHARE_CHARS", 700)
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "ba", "abc", "c", "é", "日本", "b_a"])
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += texts[:1] * 100  # a third of all texts are one
    wanted = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(70)]
    assert found(spark, texts, wanted) == brute(texts, wanted)


def test_no_texts_or_no_answers(spark):
    assert found(spark, [], ["a"]) == set() and found(spark, ["a"], []) == set() and found(spark, ["a"], ["", None]) == set()


def test_a_very_long_text(spark):
    text = "lorem ipsum " * 200_000 + "needle in hay"
    got = found(spark, [text], ["needle in", "hay", "ipsumlorem"])
    assert {(a, len(p)) for _, a, p in got} == {("needlein", 1), ("hay", 1), ("ipsumlorem", 199_999)}
