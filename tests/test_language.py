"""Languages by profiles of character runs."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from querent.operators import language, standardize

#: Plain sentences of four languages, from which labelled texts are dealt.
WORDS = {
    "en": "the house stands near the river and its garden was once the pride of our village when children would play there through summer until evening came".split(),
    "de": "das haus steht nahe am fluss und sein garten war einst der stolz unseres dorfes als kinder dort im sommer spielten bis der abend kam und licht schwand".split(),
    "fr": "la maison se trouve près de la rivière et son jardin était jadis la fierté de notre village quand les enfants y jouaient tout l été jusqu au soir".split(),
    "es": "la casa está cerca del río y su jardín fue una vez el orgullo de nuestro pueblo cuando los niños jugaban allí todo el verano hasta que llegaba la noche".split(),
}


def labelled(n, seed, words):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=words)), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_short_questions_are_told_apart(spark):
    profiles = language.fit(spark.createDataFrame(labelled(300, 1, 30), "id long, text string, lang string").withColumn("n", F.lit(1)))
    assert profiles.names == ["de", "en", "es", "fr"]
    test = labelled(400, 2, 6)
    got = {r["id"]: r["found"] for r in spark.createDataFrame(test, "id long, text string, lang string").select("id", language.detector(profiles)("text").alias("found")).collect()}
    assert sum(got[i] == lang for i, _, lang in test) >= 0.95 * len(test)


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = language.fit(docs.where(~fold))
    held = docs.where(fold).select("lang", language.detector(profiles)("text").alias("found")).where("found is not null").collect()
    assert len(held) > 100 and sum(r["lang"] == r["found"] for r in held) >= 0.95 * len(held)


def test_profiles_are_counts(spark):
    rows = [(1, "ab ab", "x"), (2, "ba", "y"), (2, "ab ab", "y"), (3, None, "x"), (4, "12 .", "x"), (5, "q", None)]
    profiles = language.fit(spark.createDataFrame(rows, "id long, text string, lang string").repartition(3))
    for name, text in (("x", "ab ab"), ("y", "ba")):
        counts = np.full(language.BUCKETS, language.SMOOTH) + np.bincount(language.runs(text), minlength=language.BUCKETS)
        assert np.allclose(profiles.logs[:, profiles.names.index(name)], np.log(counts / counts.sum()))
    assert [profiles.best(t) for t in (None, "", "12 ...", " ")] == [None] * 4
    assert profiles.best("ab ab ab") == "x" and profiles.best("ab", least=1.1) is None
    assert language.fit(spark.createDataFrame([], "text string, lang string")).best("ab") is None


def test_only_english_questions_stay(spark):
    profiles = language.fit(spark.createDataFrame(labelled(300, 3, 30), "id long, text string, lang string"))
    ask = {"q1": "When was the garden the pride of the village?", "q2": "Wann war der Garten der Stolz des Dorfes?", "q3": "", "q4": "12 / 3", "q5": "Where would the children play until evening?", "q6": "Où jouaient les enfants jusqu'au soir ?"}
    qa = json.dumps({k: {"question": v, "answers": ["a"]} for k, v in ask.items()})
    raw = spark.createDataFrame([("d", 1, qa), ("e", 2, "broken")], "docId string, n long, qa string")
    out = standardize.flatten_documents(raw, language.detector(profiles))
    assert sorted(r["questionId"] for r in out.collect()) == ["q1", "q5"]
    some = spark.createDataFrame([(k, v) for k, v in ask.items()] + [("q7", None)], "id string, question string")
    assert sorted(r["id"] for r in language.english_only(some, profiles).collect()) == ["q1", "q5"]
