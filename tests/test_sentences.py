"""Sentence boundaries that are learnt from counts."""

import random

from querent.functions.text import chunks
from querent.operators import sentences

NOUNS = "table letter house garden river engine window report meadow bridge signal market".split()
VERBS = "shows opens crosses holds follows covers".split()


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    noun, verb = lambda: rng.choice(NOUNS), lambda: rng.choice(VERBS)
    forms = [
        lambda: f"The {noun()} {verb()} the {noun()}.",
        lambda: f"Then Dr. {rng.choice(['Moss', 'Hale', 'Reed'])} {verb()} a {noun()} of approx. {rng.randrange(9)} feet.",
        lambda: f"A letter by J. {rng.choice(['Moss', 'Hale'])} {verb()} it.",
        lambda: f"Is this a {noun()}?",
        lambda: f"It takes feet to {verb()} it as the {noun()} {verb()} it with {noun()} and feet.",
        lambda: f"The {noun()}, e.g. Norwich {noun()}, {verb()} (see fig. {rng.randrange(9)}).",
    ]
    texts = []
    for i in range(n):
        own = [rng.choice(forms)() for _ in range(rng.randrange(1, 9))]
        texts.append((i, own, " ".join(own)))
    return texts


def test_abbreviations_and_initials_do_not_end_sentences(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, _, t in rows] + [(900, None, "x"), (901, "", "x"), (902, rows[0][2], "x"), (902, rows[0][2], "x")], "id long, text string, word string")
    model = sentences.learn(df)
    assert {r["word"] for r in model.stops.collect()} >= {"dr", "approx", "e.g", "fig", "j"}
    assert not {r["word"] for r in model.stops.collect()} & {*NOUNS, "feet", "it"}
    assert {"the", "then", "is"} <= {r["word"] for r in model.starters.collect()}
    got = sentences.split(df, model).collect()
    assert len(got) == len(rows) + 4 and got[0].asDict().keys() == {"id", "text", "word", "sentences"}
    by_id = {r["id"]: r["sentences"] for r in got}
    assert by_id[900] is None and by_id[901] == [""] and by_id[902] == rows[0][1]
    assert all(by_id[i] == own for i, own, _ in rows)


def test_white_space_within_sentences_stays(spark):
    df = spark.createDataFrame([(i, t) for i, _, t in corpus()], "id long, text string")
    model = sentences.learn(df)
    odd = spark.createDataFrame([(1, "Then Dr.  \n Moss holds it.\n\nThe river (e.g. Dr. \tHale) opens!  'Is it?' Yes. ")], "id long, text string")
    got = sentences.split(odd, model).first()["sentences"]
    assert got == ["Then Dr.  \n Moss holds it.", "The river (e.g. Dr. \tHale) opens!", "'Is it?'", "Yes. "]


def test_a_very_long_text_and_no_texts(spark):
    rows = corpus(300)
    long = [s for _, own, _ in rows * 20 for s in own]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "id long, text string")
    model = sentences.learn(df)
    one = spark.createDataFrame([(1, " ".join(long))], "id long, text string")
    assert sentences.split(one, model).first()["sentences"] == long
    none = df.limit(0)
    nothing = sentences.learn(none)
    assert sentences.split(none, nothing).count() == 0
    assert sentences.split(one.limit(1), nothing).first()["sentences"][0]  # candidates stay as they are


def test_chunks_of_learnt_sentences(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "id long, text string")
    cut = sentences.split(df, sentences.learn(df))
    got = {r["id"]: r["c"] for r in cut.select("id", chunks(cut["sentences"], 40).alias("c")).collect()}
    for i, own, _ in rows:
        assert "".join(got[i]) == "".join(own) and all(len(c) <= 40 for c in got[i])


def test_log_likelihoods(spark):
    import math

    from pyspark.sql import functions as F

    def plain(both, first, second, n):
        def part(k, m, p):
            return (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)

        p, p1, p2 = second / n, both / first, (second - both) / (n - first)
        return 2 * (part(both, first, p1) + part(second - both, n - first, p2) - part(both, first, p) - part(second - both, n - first, p))

    for case in ((3, 10, 5, 100), (10, 10, 10, 100), (1, 50, 60, 1000), (0, 5, 5, 40)):
        got = spark.range(1).select(sentences.surprise(*(F.lit(x) for x in case)).alias("x")).first()["x"]
        assert abs(got - plain(*case)) < 1e-9


def test_patterns_see_distinct_tokens_and_white_space_is_of_one_kind(spark):
    df = spark.createDataFrame([(" So Dr. Moss\tsaw (it).\n\"Dr. Moss\" saw: It!  ",)] * 50 + [(None,), ("",), (" \n",)], "text string")
    got = {(r["token"], r["before"], r["follows"]): r["n"] for r in sentences.token_counts(df, "text").collect()}
    first = [("So", None, False), ("Dr.", None, True), ("Moss", "Dr.", False), ("saw", None, True), ("(it).", None, True), ('"Dr.', "(it).", False), ('Moss"', '"Dr.', False), ("saw:", None, True), ("It!", None, False)]
    assert got == dict.fromkeys(first, 50)
    words = {r["word"]: tuple(r)[1:] for r in sentences.word_counts(df).collect()}
    assert words["dr"] == (100, 0, 0, 50) and words["it)"] == (50, 0, 50, 0) and words["saw"] == (0, 100, 100, 0) and words["moss"] == (0, 100, 0, 0)


def test_only_doubtful_places_meet_the_words_with_capitals(spark):
    """Places behind no abbreviation have no word to look up: they must not come to one task by an empty key."""
    df = spark.createDataFrame([(i, t) for i, _, t in corpus()], "id long, text string")
    model = sentences.learn(df)
    places = spark.createDataFrame([("so!", "Then"), ("feet.", "The"), ("Dr.", "Moss"), ("Dr.", "Then"), ("J.", "Hale"), ("?", "It")], "last string, next string")
    assert sorted(map(tuple, sentences.inside(places, model).collect())) == [("Dr.", "Moss"), ("J.", "Hale")]
