"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querent.llm.common import arrow_batches, discard, materialize
from querent.llm.quality_rules import FEATURES, statistics

#: Labellers on the statistics of quality_rules: statistic, and where it votes bad and where good (a test and
#: a limit each, or None). A labeller abstains elsewhere.
LABELLERS = (
    ("symbols_per_word", (">", 0.3), ("<", 0.1)),
    ("repeated", (">", 0.5), ("<", 0.2)),
    ("dup_lines", (">", 0.3), None),
    ("capitals", (">", 0.4), ("<", 0.15)),
    ("marks", (">", 0.03), ("<", 0.01)),
    ("same_as_last", (">", 0.2), ("<", 0.02)),
    ("distinct_words", ("<", 0.15), None),
    ("lowercase", ("<", 0.3), (">", 0.6)),
)
#: Buckets of the hashed scorer, a power of two, and the bound on the documents it is fitted on.
BUCKETS = 1 << 18
FIT_ROWS = 8_000
#: Bound on the buckets of all those documents together; beyond it the last ones by the hash of their id don't count.
FIT_VALUES = 8_000_000
SEED = 11
KEEP_AT = 0.5
#: Words of which a Python worker remembers the weight.
REMEMBERED = 400_000

_NAMES = list(FEATURES)
_CLASSES = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))


def votes(features: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 of each labeller (columns) for each row of statistics."""
    out = np.zeros((len(features), len(LABELLERS)), dtype=np.int8)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = features[:, _NAMES.index(name)]
        for rule, vote in ((good, 1), (bad, -1)):
            if rule:
                out[(x > rule[1]) if rule[0] == ">" else (x < rule[1]), k] = vote
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """Each row of votes as one number."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


@dataclass
class Labels:
    """What EM estimates: shares of the hidden classes and P(vote | class) as [labeller, class, vote + 1].

    The last class is good text. The others are kinds of bad text, one for each labeller, since texts that are
    bad in different ways don't draw the same votes.
    """

    shares: np.ndarray
    table: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """P(class | votes), a row for each row of votes."""
        log = np.log(self.shares) + sum(np.log(self.table[k][:, v[:, k].astype(np.int64) + 1].T) for k in range(v.shape[1]))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes) for each row."""
        return self.classes(v)[:, -1] if len(v) else np.zeros(0)

    def accuracies(self) -> np.ndarray:
        """Of each labeller, the probability that a vote it casts is right."""
        right = self.table[:, :-1, 0] @ self.shares[:-1] + self.table[:, -1, 2] * self.shares[-1]
        return right / np.maximum((self.table[:, :, 0] + self.table[:, :, 2]) @ self.shares, 1e-12)


def estimate(v: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 0.5) -> Labels:
    """EM over distinct vote patterns with their counts.

    It starts from the votes: a text that a labeller calls bad may be of its kind, one that none does is good.
    """
    k = v.shape[1]
    shares, table = np.full(k + 1, 1 / (k + 1)), np.full((k, k + 1, 3), 1 / 3)
    if not counts.sum():
        return Labels(shares, table)
    belief = np.concatenate([(v < 0) * 1.0, (v.min(axis=1, keepdims=True) >= 0) * 1.0], axis=1) + 1e-3
    belief /= belief.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = belief * counts[:, None]
        before = table
        table = np.stack([np.stack([weight[v[:, j] == vote].sum(axis=0) for vote in (-1, 0, 1)], axis=1) for j in range(k)]) + smooth
        table /= table.sum(axis=2, keepdims=True)
        shares = (weight.sum(axis=0) + smooth) / (counts.sum() + smooth * (k + 1))
        belief = Labels(shares, table).classes(v)
        if np.abs(table - before).max() < 1e-7:
            break
    return Labels(shares, table)


def features_of(text: str | None) -> np.ndarray:
    return np.array(statistics(text)[1])


def buckets(word: bytes) -> tuple[int, int]:
    """A word's two buckets: its own, and that of its first and last characters by class."""
    shape = (word[:1] + word[-3:]).translate(_CLASSES)
    return crc32(word) & (BUCKETS - 1), crc32(shape, 1) & (BUCKETS - 1)


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares of its words; bucket 0 also takes words that repeat the one before."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    ids = [b for w in words for b in buckets(w)]
    ids += [0] * sum(map(bytes.__eq__, words, words[1:]))
    where, n = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
    return where, n / len(words)


def fit_scorer(docs: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 1.0, shrink: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by full-batch Adagrad."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(docs):
        return weights, bias
    sizes = np.array([len(a) for a, _ in docs])
    where = np.concatenate([a for a, _ in docs])
    value = np.concatenate([b for _, b in docs])
    used, where = np.unique(where, return_inverse=True)  # the other buckets keep weight zero
    every, weights = weights, np.zeros(len(used))
    row = np.repeat(np.arange(len(docs)), sizes)
    seen, seen_bias = np.full(len(used), 1e-8), 1e-8
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 0.02), 0.5 / max(1 - target.mean(), 0.02))
    for _ in range(rounds):
        margin = np.bincount(row, weights=value * weights[where], minlength=len(docs)) + bias
        off = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) * balance / len(docs)
        grad = np.bincount(where, weights=value * off[row], minlength=len(used)) + shrink * weights
        seen += grad * grad
        seen_bias += off.sum() ** 2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * off.sum() / np.sqrt(seen_bias)
    every[used] = weights
    return every, float(bias)


class Scorer:
    """Adds up remembered word weights."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def probability(self, text: str | None) -> float:
        words = (text or "").encode("utf-8", "replace").split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(words) - known.keys() if len(known) < len(words) else {w for w in words if w not in known}
        for w in new:
            a, b = buckets(w)
            known[w] = float(self.weights[a] + self.weights[b])
        n = max(len(words), 1)
        twice = sum(map(bytes.__eq__, words, words[1:]))
        margin = self.bias + (sum(map(known.__getitem__, words)) + twice * float(self.weights[0])) / n
        return float(1 / (1 + np.exp(-min(max(margin, -500.0), 500.0))))


def estimate_labels(docs: DataFrame, text_col: str = "text") -> Labels:
    """EM over all documents: what reaches the driver is a count for each of at most 3^labellers vote patterns."""
    import pyarrow as pa

    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features_of(t) for t in b.column(0).to_pylist()])
                which, n = np.unique(pattern(votes(x)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n)], names=["pattern", "n"])

    counted = docs.select(text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    which = counted.column("pattern").to_numpy()
    v = (which[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)
    return estimate(v, counted.column("n").to_numpy().astype(float))


def fit(docs: DataFrame, labels: Labels, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """The scorer, fitted on the posterior labels of at most `rows` documents with at most FIT_VALUES buckets, chosen by a
    hash of their id."""
    import pyarrow as pa

    key = F.xxhash64(F.lit(SEED), F.col(id_col))
    some = docs.where(F.col(id_col).isNotNull()).select(id_col, key.alias("order_")).orderBy("order_", id_col).limit(rows).distinct()
    texts = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select("order_", text_col)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            if not texts:
                continue
            p = labels.posterior(votes(np.array([features_of(t) for t in texts])))
            both = [hashed(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(p), pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in both], pa.list_(pa.float32())),
            ], names=["order_", "p", "at", "share"])

    fitted = materialize(texts.mapInArrow(run, "order_ long, p double, at array<int>, share array<float>"), "fitted")
    upto = F.sum(F.size("at")).over(W.partitionBy().orderBy("order_"))  # over at most `rows` narrow rows
    last = fitted.select("order_", upto.alias("upto")).where(F.col("upto") <= FIT_VALUES).agg(F.max("order_")).first()[0]
    got = fitted.where(F.col("order_") <= F.lit(last)).toArrow() if last is not None else fitted.limit(0).toArrow()
    discard(fitted)
    target = got.column("p").to_numpy()
    at, share = (got.column(c).combine_chunks() for c in ("at", "share"))
    ends, where, value = at.offsets.to_numpy(), at.values.to_numpy().astype(np.int64), share.values.to_numpy().astype(float)
    docs_ = [(where[i:j], value[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    order = sorted(range(len(docs_)), key=lambda i: (target[i], docs_[i][0].tobytes()))  # the same, however rows arrive
    return fit_scorer([docs_[i] for i in order], target[order])


def classify(docs: DataFrame, labels: Labels, scorer: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(id, n_bad, n_good, posterior, score, kept) for every row of docs: votes, P(good) by the labellers, P(good)
    by the scorer, and whether that is at least keep_at.

    Null and empty texts have no words and are not kept; repeated rows are judged alike; an empty table gives
    an empty result; other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((scorer[0].astype(np.float32), scorer[1]))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bad", "n_good", "posterior", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            v = votes(np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES)))
            score = np.array([own.probability(t) for t in texts], dtype=float)
            some = np.array([bool(t and t.strip()) for t in texts], dtype=bool)
            columns = ((v < 0).sum(axis=1), (v > 0).sum(axis=1), labels.posterior(v), score, some & (score >= keep_at))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bad long, n_good long, posterior double, score double, kept boolean")


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """estimate_labels(), fit() and classify() in one."""
    labels = estimate_labels(docs, text_col)
    return classify(docs, labels, fit(docs, labels, id_col, text_col), id_col, text_col)
