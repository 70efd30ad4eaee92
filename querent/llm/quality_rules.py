"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over those statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.boosting import Trees, constant, fit
from querent.llm.common import arrow_batches

#: At most this many labelled documents are used to fit the trees, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Documents with fewer words fail, and those of whose words more than this percentage repeats.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is kept if the trees give it at least this probability of good quality.
KEEP_AT = 0.5
#: Fixed set of characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: What the trees see, and whether quality may only rise (+1) or fall (-1) with it.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeated": -1, "capitals": -1,
    "digits": 0, "distinct_words": 0, "marks": -1, "words_per_line": 0, "same_as_last": -1, "lowercase": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(words)
    if n < 4 or len(set(zip(words, words[1:], words[2:]))) == n - 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(n, dtype=bool)
    for i in range(3):
        inside[i : n - 2 + i] |= twice
    return int(inside.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the values of FEATURES for one whole text; null is as empty.

    Words are what stands between ASCII white space; word_chars counts code points.
    """
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    some = max(n, 1)
    letters = max(len(raw), 1)
    cut = lambda a: (len(raw) - len(raw.translate(None, a))) / letters
    features = (
        float(np.log1p(n)), chars / some, symbols / some, dup_lines / max(len(lines), 1), repeated / some,
        cut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), cut(b"0123456789"), len(set(words)) / some, cut(b"!?"),
        n / max(len(lines), 1), sum(map(bytes.__eq__, words, words[1:])) / some, cut(b"abcdefghijklmnopqrstuvwxyz"),
    )
    return (n, chars, symbols, dup_lines, repeated), features


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on the statistics of at most `rows` labelled documents (null labels don't count; of
    several labels the smallest holds). Without labelled documents of both kinds: a model that keeps all."""
    import pyarrow as pa

    some = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(id_col).agg(F.min(label_col).cast("double").alias("label_"))
        .orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    texts = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select(text_col, "label_")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [list(statistics(t)[1]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label_", "x"])

    got = texts.mapInArrow(run, "label_ double, x array<double>").toArrow()
    if not got.num_rows:
        return constant(1.0)
    x = np.array(got.column("x").to_pylist())
    y = got.column("label_").to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees, however the rows arrive
    return fit(x[order], y[order], np.array(list(FEATURES.values())))


def judge(texts: list[str | None], trees: Trees, keep_at: float = KEEP_AT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, base_failed, score, kept) for a batch of texts."""
    both = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
    failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
    score = trees.probability(np.array([f for _, f in both]).reshape(-1, len(FEATURES)))
    return counts, failed, score, ~failed & (score >= keep_at)


def quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(id, the counts, base_failed, score, kept) for every row of docs.

    kept is false where base_failed is true, else the trees' verdict. Null and empty texts have no words and
    fail; repeated rows are judged alike; an empty table gives an empty result; other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *COUNTS, "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, score, kept = judge(b.column(1).to_pylist(), trees, keep_at)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (*counts.T, failed, score, kept))], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table gives an empty one.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist(), trees, keep_at)[3]))

    return docs.mapInArrow(run, docs.schema)
