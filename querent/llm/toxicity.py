"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

Toxic texts are confirmed by labels; all other text that the model sees is unlabelled, whatever it holds. With the share
of toxic texts, the class prior, the risk of the unlabelled texts less that of the toxic ones among them estimates the
risk of clean text. Where that estimate falls below zero the model has learnt its examples by heart, and the step is
taken back instead (the non-negative risk).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import arrow_batches, discard, materialize

#: Bounds of what the classifier is fitted on, chosen by a hash of their id: toxic texts, unlabelled texts, and the
#: features of all of them together, beyond which texts that come later by that hash don't count.
FIT_TOXIC, FIT_UNLABELLED = 3_000, 9_000
FIT_VALUES = 16_000_000
#: Rows of one in FOLDS ids are held out: crc32 of the id as text, modulo FOLDS, is zero.
FOLDS = 5
#: Features are buckets of whole words and their beginnings of these lengths.
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7)
#: Features that the model weighs at most, and how many toxic texts must have one.
CHOSEN, LEAST_TEXTS = 6_000, 2
#: How unlikely its toxic texts must be by chance, as a natural logarithm.
SURPRISE = 11.0
#: Share that toxic texts are taken for if no label tells, and the steps of the fit.
PRIOR = 0.1
STEPS, RATE, SHRINK = 300, 0.3, 3e-3
#: The unlabelled risk may fall so far below the toxic share of it before a step is taken back, and that step's scale.
BELOW, BACK = 0.0, 1.0
SEED = 13
#: Hashes by which near copies among the texts of the fit are found, and their modulus.
MINIMA, _PRIME = 16, (1 << 31) - 1
_FACTORS = np.random.default_rng(SEED).integers(1 << 20, 1 << 31, MINIMA) | 1
#: Words of which a Python worker remembers the features.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text: runs of letters, in lower case."""
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """A word's buckets: the word itself, and its beginnings."""
    raw = word.encode("utf-8", "replace")
    return [crc32(raw, 1) % BUCKETS, *(crc32(word[:n].encode("utf-8", "replace"), 2) % BUCKETS for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Weights of the chosen buckets and a bias, for texts in which a bucket occurs or doesn't."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    _places: dict[int, int] = field(default_factory=dict)
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self._places = {b: i for i, b in enumerate(self.chosen.tolist())}

    def present(self, text: str | None) -> list[int]:
        """The chosen features that a text has."""
        known, places, out = self._known, self._places, set()
        if len(known) > REMEMBERED:
            known.clear()
        for w in words(text):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(places[b] for b in features(w) if b in places)
            if at:
                out.update(at)
        return sorted(out)

    def probability(self, text: str | None) -> float:
        margin = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-min(max(margin, -500.0), 500.0))))


def minima(text: np.ndarray) -> np.ndarray:
    """A text's smallest number under each of MINIMA hashes of its buckets."""
    return (text[None, :] * _FACTORS[:, None] % _PRIME).min(axis=1) if len(text) else np.full(MINIMA, -1)


def distinct(texts: list[np.ndarray], least: list[np.ndarray]) -> list[np.ndarray]:
    """The texts without copies and near copies, of which the first stays: one text's words would seem to be many texts'.

    Two texts are near copies if at least half of their minima agree. least: the texts' minima.
    """
    known: dict[tuple[int, int], list[int]] = {}
    out: list[np.ndarray] = []
    for text, low in zip(texts, least):
        keys = list(enumerate(low.tolist()))
        met = [i for k in keys for i in known.get(k, ())]
        if met and np.bincount(met).max() * 2 >= MINIMA:
            continue
        for k in keys:
            known.setdefault(k, []).append(len(out))
        out.append(text)
    return out


def choose(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """The buckets that speak most for toxic text: those with more toxic texts among all that have one than chance gives.

    Of the unlabelled texts with a bucket as many count as the prior leaves for clean ones.
    """
    if not toxic:
        return np.zeros(0, dtype=np.int64)
    at, n = np.unique(np.concatenate(toxic), return_counts=True)
    at, n = at[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS].astype(float)
    if not len(at):
        return at
    other = np.concatenate(unlabelled) if unlabelled else np.zeros(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(at, other), len(at) - 1)
    seen = np.bincount(place[at[place] == other], minlength=len(at))
    clean = np.maximum(seen - prior * len(unlabelled) * n / len(toxic), 0)
    share, chance = n / (n + clean), len(toxic) / (len(toxic) + (1 - prior) * len(unlabelled))
    rest = np.where(clean > 0, clean * np.log(np.maximum(1 - share, 1e-300) / max(1 - chance, 1e-9)), 0)
    surprise = np.where(share > chance, n * np.log(share / chance) + rest, 0)
    order = np.lexsort((at, -surprise))[:CHOSEN]
    return at[order[surprise[order] >= SURPRISE]]


def _rows(docs: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the chosen) of every chosen feature of the texts."""
    if not docs or not len(chosen):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(chosen)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    all_ = np.concatenate(docs)
    at = np.minimum(np.searchsorted(chosen[order], all_), len(chosen) - 1)
    hit = chosen[order][at] == all_
    return row[hit], order[at[hit]]


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Model:
    """A logistic model of the texts' buckets by the non-negative risk, in full batches with Adam.

    Without toxic or without unlabelled texts nothing can be learnt: every text gets the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    chosen = choose(toxic, unlabelled, prior)
    weights, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    if not len(chosen) or not unlabelled:
        return Model(chosen[:0], weights[:0], bias, prior)
    sides = [(*_rows(d, chosen), len(d)) for d in (toxic, unlabelled)]
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        p = []
        for row, at, n in sides:
            margin = np.bincount(row, weights=weights[at], minlength=n) + bias
            p.append((np.clip(margin, -50, 50), 1 / (1 + np.exp(-np.clip(margin, -50, 50)))))
        (m_t, p_t), (m_u, p_u) = p
        soft = lambda x: np.log1p(np.exp(x))
        clean_risk = soft(m_u).mean() - prior * soft(m_t).mean()
        if clean_risk >= -BELOW:
            by_row = (prior * (p_t - 1) - prior * p_t) / sides[0][2], p_u / sides[1][2]
        else:
            by_row = BACK * prior * p_t / sides[0][2], -BACK * p_u / sides[1][2]
        grad = np.zeros(len(chosen) + 1)
        for (row, at, _), g in zip(sides, by_row):
            grad[:-1] += np.bincount(at, weights=g[row], minlength=len(chosen))
            grad[-1] += g.sum()
        grad[:-1] += SHRINK * prior * weights / max(len(chosen), 1) ** 0.5
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10) / np.sqrt(step)
        weights, bias = weights - move[:-1], bias - move[-1]
    used = np.abs(weights) > 1e-4
    return Model(chosen[used], weights[used], float(bias), prior)


def held_out(id_: F.Column) -> F.Column:
    """Whether a row is held out: by the crc32 of its id as text; false for rows without an id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          toxic_rows: int = FIT_TOXIC, unlabelled_rows: int = FIT_UNLABELLED, prior: float | None = None) -> Model:
    """The model, from at most toxic_rows texts whose label is 1 and at most unlabelled_rows texts of docs, whatever their
    labels, all outside the held-out fold. The prior is the share of label 1 among all labels outside the fold.

    Null labels and ids don't count; of several labels of an id the largest holds; of an id's rows the one whose text has
    the smallest hash counts.
    """
    import pyarrow as pa

    id_ = F.col(f"`{id_col}`")
    known = labels.where(id_.isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~held_out(id_))
    known = known.groupBy(id_.alias("id_")).agg((F.max(F.col(f"`{label_col}`")) >= 1).alias("toxic_"))
    if prior is None:
        n, hits = known.agg(F.count("*"), F.sum(F.col("toxic_").cast("long"))).first()
        prior = hits / n if hits else PRIOR
    key = F.xxhash64(F.lit(SEED), "id_")
    some = known.where("toxic_").select("id_", key.alias("order_"), F.lit(True).alias("toxic_")).orderBy("order_", "id_").limit(toxic_rows)
    ids = docs.where(id_.isNotNull() & ~held_out(id_)).select(id_.alias("id_")).distinct()
    others = ids.select("id_", key.alias("order_"), F.lit(False).alias("toxic_")).orderBy("order_", "id_").limit(unlabelled_rows)
    picked = F.broadcast(some.unionByName(others))  # at most toxic_rows + unlabelled_rows narrow rows
    texts = docs.select(id_.alias("id_"), F.col(f"`{text_col}`").alias("text_")).join(picked, "id_")
    # an id may have any number of rows: each task keeps one of them, so what is picked stays bounded
    texts = texts.groupBy("order_", "toxic_").agg(F.min_by("text_", F.xxhash64("text_")).alias("text_"))
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [sorted({x for w in words(t) for x in features(w)}) for t in b.column(2).to_pylist()]
            low = [minima(np.array(a, dtype=np.int64)) for a in at]
            columns = pa.array([len(a) for a in at], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(low, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["order_", "toxic_", "n", "at", "low"])

    fitted = materialize(texts.mapInArrow(run, "order_ long, toxic_ boolean, n long, at array<int>, low array<long>"), "fitted")
    sizes = fitted.groupBy("order_").agg(F.sum("n").alias("n")).orderBy("order_").toArrow()  # one narrow row for each picked id
    upto = np.cumsum(sizes.column("n").to_numpy())
    within = int(np.searchsorted(upto, FIT_VALUES, side="right"))
    got = fitted.where(F.col("order_") <= F.lit(sizes.column("order_")[within - 1].as_py())).toArrow() if within else fitted.limit(0).toArrow()
    discard(fitted)
    lists = got.column("at").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    low = np.array(got.column("low").to_pylist(), dtype=np.int64).reshape(-1, MINIMA)
    rows = list(zip(got.column("toxic_").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), low))
    sides = []
    for toxic in (True, False):
        side = sorted(((values[i:j], m) for t, i, j, m in rows if t == toxic), key=lambda x: (len(x[0]), x[0].tobytes()))  # the same, however rows arrive
        sides.append(distinct([a for a, _ in side], [m for _, m in side]))
    return fit(*sides, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs: P(toxic) by the text alone, and whether it is at least 0.5.

    Null and empty texts have no words and get the score of such; repeated rows are scored alike; an empty table gives an
    empty result; other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.chosen, model.weights, model.bias, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            p = np.array([own.probability(t) for t in b.column(2).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **settings) -> DataFrame:
    """learn() and score() in one. settings: those of learn()."""
    return score(docs, learn(docs, labels, id_col, text_col, label_col, **settings), id_col, text_col)
