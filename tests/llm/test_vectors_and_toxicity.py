"""Vector codes, clusters and toxicity: brute force, odd rows, and what is sent in a round."""

import hashlib
import math
from zlib import crc32

import duckdb
import numpy as np
import pytest

from querent.llm import block_norms, delta_lloyd, toxicity

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, part int, v string, code string"


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, centres):
    return min(range(len(centres)), key=lambda i: (squared(v, centres[i]), i))


def lloyd(rows, centres, rounds):
    """(centres, nearest of each row) by loops over Python's integers."""
    for _ in range(rounds):
        at = [nearest(v, centres) for v in rows]
        for i in range(len(centres)):
            mine = [v for v, a in zip(rows, at) if a == i]
            if mine:
                centres[i] = [sum(c) // len(mine) for c in zip(*mine)]
    return centres, [nearest(v, centres) for v in rows]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def some_vectors(dims, n=120, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (7, dims))
    rows = [(int(i), [float(np.float32(x)) for x in centre[i % 7] + rng.normal(0, 0.05, dims)], int(i % 3) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(900 + i, rows[0][1], 1) for i in range(60)]  # a third of all rows are one vector
    rows += [(2, rows[5][1], None), (2, rows[5][1], None), (None, rows[6][1], 0)]  # repeated rows, no id
    rows += [(-5, None, 0), (-4, [None] * dims, 0), (-3, [float("nan")] * dims, 1), (-2, [float("inf"), *[0.0] * (dims - 1)], 1), (-1, [], 2), (-6, [0.5] * (dims + 4), 2)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(3)


def first_of_codes(rows):
    return [v for _, v in sorted((i, v) for i, v, _ in rows if i is not None)]


@pytest.mark.parametrize("scale", [1024, 1 << 24])
def test_vector_codes_by_loops(spark, scale):
    rows = [r for r in some_vectors(8) if r[0] != -6]
    got = sorted(delta_lloyd.vector_codes(table(spark, rows), entries=16, scale=scale).collect(), key=str)
    kept = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if usable(v)]
    start = first_of_codes(kept)[:16]
    books, at = zip(*(lloyd([v[p : p + 2] for _, v, _ in kept], [v[p : p + 2] for v in start], 4) for p in (0, 2, 4, 6)))
    error = [sum(squared(v[2 * p : 2 * p + 2], books[p][at[p][k]]) for p in range(4)) for k, (_, v, _) in enumerate(kept)]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    name = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    want = sorted(((i, "".join(f"{at[p][k]:02x}" for p in range(4)), error[k], by_label[label], name) for k, (i, _, label) in enumerate(kept)), key=str)
    assert [tuple(r) for r in got] == want or sorted(map(tuple, got), key=str) == want


def test_vector_codes_take_the_length_of_the_first_vector(spark):
    rows = [(1, [0.1] * 8, 0), (2, [0.2] * 12, 0), (3, [0.3] * 8, 0), (0, [0.3] * 7, 0)]
    assert sorted(r["vec_id"] for r in delta_lloyd.vector_codes(table(spark, rows)).collect()) == [1, 3]


def test_a_round_sends_only_what_moved(spark):
    rows = some_vectors(8)[:120]
    kept = table(spark, rows)
    state, books = delta_lloyd.train(kept, entries=8, rounds=3)
    state = state.withColumn("code", state["code"])
    again = delta_lloyd.one_round(state, books)
    moved = {tuple(r) for r in again.where("part is not null and n <> 0").select("part", "entry", "n").collect()}
    before = {r["id_"]: r["code"] for r in state.collect()}
    after = {r["id_"]: r["code"] for r in again.where("part is null").collect()}
    changed = sum(a != b for i in before for a, b in zip(before[i], after[i]))
    assert sum(n for _, _, n in moved if n > 0) <= changed
    settled = delta_lloyd.one_round(again.where("part is null").select("id_", "label_", "v", "code"), books)
    assert settled.where("part is not null").count() == 0  # nothing moves, nothing is sent


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert delta_lloyd.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert delta_lloyd.vector_codes(none).count() == 0
    assert delta_lloyd.vector_codes(spark.createDataFrame([(1, None, 2), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_clusters_by_loops(spark):
    rows = some_vectors(64, n=90)
    got = {(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in block_norms.clusters(table(spark, rows), k=12).collect()}
    kept = [(i, [math.floor(x * 256) for x in v]) for i, v, _ in rows if usable(v) and len(v) == 64]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:12]
    centres, at = lloyd([v for _, v in kept], [list(v) for _, v in first], 5)
    distance = [squared(v, centres[a]) for (_, v), a in zip(kept, at)]
    of = lambda a: sum(d for d, b in zip(distance, at) if b == a)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert got == {(i, a, d, of(a), sum(distance), name[a]) for (i, _), a, d in zip(kept, at, distance)}


@pytest.mark.parametrize("spread", [3, 300, 100_000, 1 << 28])
def test_bounds_never_rule_out_the_nearest(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (40, 64))
    centres[7] = centres[3]  # of equal centroids the first
    v = np.concatenate([centres[rng.integers(0, 40, 300)] + rng.integers(-spread // 4 - 1, spread // 4 + 2, (300, 64)), centres, np.zeros((1, 64), dtype=np.int64)])
    which, best, exact = block_norms.assign(v, block_norms.compressed(v), centres)
    d = ((v[:, None, :].astype(object) - centres[None, :, :].astype(object)) ** 2).sum(axis=2)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert (block_norms.bounds(block_norms.compressed(v), centres) <= d.astype(float)).all()
    assert exact[-1] <= 40 and exact[:-1].mean() < 4  # nearly all centroids are ruled out


def test_bounds_rule_out_most_centroids_of_the_tables():
    rows = duckdb.sql(f"select embedding from '{DATA}/embeddings.parquet'").fetchall()
    v = np.floor(np.array([r[0] for r in rows]) * 256).astype(np.int64)
    exact = block_norms.assign(v, block_norms.compressed(v), v[:40])[2]
    assert exact.mean() < 3


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([(1, [0.5] * 63), (2, None)], "vec_id long, embedding array<float>")
    assert block_norms.clusters(none).count() == 0


@pytest.mark.parametrize("name", ["op11_delta_lloyd_codes", "op12_block_norm_clusters"])
def test_vector_queries_equal_sql(spark, name):
    from querent.llm import queries

    ours = queries.QUERIES[name](spark, DATA).toPandas()
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    theirs = duck.sql(queries.ORACLE[name]).df()
    same = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
    assert sorted(ours.columns) == sorted(theirs.columns) and same(ours) == same(theirs)


PLAIN = ["".join(w) for w in np.random.default_rng(1).choice(list("abcdefghijklmnopqrstu"), (3000, 6))]


def talk(rng, n, bad):
    out = rng.choice(PLAIN, n).tolist()
    for i in rng.integers(0, n, 3 if bad else 0):
        out[i] = rng.choice(["vilegun", "vileder", "vileham", "moronic"])
    return " ".join(out)


def test_toxicity_is_learnt_from_positive_and_unlabelled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, talk(rng, int(rng.integers(5, 300)), i % 7 == 0), "x", 1.0, True) for i in range(1500)]
    rows += [(2000, None, None, None, None), (2001, "", "x", None, None), (None, "vilegun", "x", None, None), (2002, "vilegun " * 200_000, "x", 1.0, False), (7, rows[7][1], "x", 1.0, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 7 == 0), 0) for i in range(0, 1500, 2)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, predicted int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    fold = {r["doc_id"]: r["held_out"] for r in got}
    assert all(h == (i is not None and crc32(str(i).encode()) % 5 == 0) for i, h in fold.items())
    test = [(r["doc_id"] % 7 == 0, r["predicted"]) for r in got if r["held_out"] and r["doc_id"] < 1500]
    assert sum(y == bool(p) for y, p in test) / len(test) > 0.98
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[2000] == score[2001] < 0.5 < score[2002] and score[None] > 0.5
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1


def test_toxicity_uses_no_label_of_the_held_out_fold(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, talk(rng, 40, i % 4 == 0)) for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    turned = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.chosen.tolist() == b.chosen.tolist() and a.weights.tolist() == b.weights.tolist() and (a.bias, a.prior) == (b.bias, b.prior)


def test_many_rows_of_one_id_count_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, talk(rng, 40, i % 4 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    once = toxicity.learn(spark.createDataFrame(rows, schema), labels)
    often = toxicity.learn(spark.createDataFrame(rows + [rows[4]] * 400, schema).repartition(5), labels)
    assert once.chosen.tolist() == often.chosen.tolist() and once.weights.tolist() == often.weights.tolist()


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.toxicity(docs, none).collect()} == {toxicity.PRIOR}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_risk_of_clean_text_stays_non_negative():
    """Texts with a word of their own can be learnt by heart; the step back keeps unlabelled texts from all being clean."""
    rng = np.random.default_rng(8)
    toxic = [np.unique(np.append(rng.integers(0, 40, 12), 100 + rng.integers(0, 3))) for _ in range(80)]
    clean = [np.unique(rng.integers(0, 40, 12)) for _ in range(400)]
    model = toxicity.fit(toxic, clean + toxic[:40], 0.1)
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist()))
    assert all(weight.get(x, 0) > 1 for x in (100, 101, 102)) and model.bias < 0


def test_copies_of_a_text_count_once():
    rng = np.random.default_rng(9)
    one = np.sort(rng.choice(10_000, 300, replace=False))
    near = [np.unique(np.append(one[:295], 20_000 + np.arange(i, i + 5))) for i in range(50)]
    others = [np.sort(rng.choice(10_000, 300, replace=False)) for _ in range(20)]
    texts = [one, *near, *others]
    assert len(toxicity.distinct(texts, [toxicity.minima(t) for t in texts])) == 21
