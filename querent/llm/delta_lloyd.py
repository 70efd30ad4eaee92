"""Vector codes by Lloyd's method, maintained by deltas.

Vectors are cut into parts, each with a codebook of its own. A round's table holds every part's assignment beside the
vector, and the running integer sums of all entries are a table of their own. A round assigns anew and sends only what
parts whose assignment changed take from their former entry and bring to the new one; tasks add these up before
they are shuffled, so a round in which little moves shuffles little, and an entry of any number of parts is a few rows.
All is in integers, so neither the order of rows nor a task that runs again has a bearing on the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import arrow_batches, discard, lookup, materialize

#: A component is taken times this and rounded down.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Up to this size squared distances of 64 components are exact as doubles; beyond it Python's integers are used.
EXACT = 1 << 21


def usable(vector: F.Column) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: F.Column, scale: int) -> F.Column:
    """The components times scale, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of `width` integers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry to each row, of equal ones the lowest, and its squared distance."""
    if max(np.abs(v).max(initial=0), np.abs(entries).max(initial=0)) > EXACT:
        v, entries = v.astype(object), entries.astype(object)
        d = (v * v).sum(axis=1)[:, None] - 2 * v.dot(entries.T) + (entries * entries).sum(axis=1)[None, :]
    else:
        v, entries = v.astype(np.float64), entries.astype(np.float64)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(v)), at].astype(np.int64)


class Deltas:
    """What the parts of a task bring to each entry, less what they take from it."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n = np.zeros((parts, entries), dtype=np.int64)
        self.sums = np.zeros((parts, entries, width), dtype=np.int64)

    def move(self, part: int, v: np.ndarray, before: np.ndarray, now: np.ndarray) -> None:
        """Rows v of a part go from entry `before` (-1: from none) to entry `now`."""
        changed = before != now
        for sign, to, some in ((1, now, changed), (-1, before, changed & (before >= 0))):
            np.add.at(self.n[part], to[some], sign)
            np.add.at(self.sums[part], to[some], sign * v[some])

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        """(part, entry, n, sums) of the entries that anything came to or went from."""
        touched = (self.n != 0) | (self.sums != 0).any(axis=2)
        return [(int(p), int(e), int(self.n[p, e]), self.sums[p, e].tolist()) for p, e in zip(*np.nonzero(touched))]


def added(deltas: DataFrame) -> DataFrame:
    """(part, entry, n, sums): rows of the same part and entry added up, component by component."""
    one = deltas.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    total = one.groupBy("part", "entry", "at").agg(F.sum("value").alias("value"))
    every = total.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("all_"))  # of one entry: its components
    values = F.transform("all_", lambda x: x["value"])
    return every.select("part", "entry", F.get(values, F.lit(0)).alias("n"), F.slice(values, F.lit(2), F.size(values)).alias("sums"))


def start(kept: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The first vectors by id as [part, entry, component]; rows without an id are none of them."""
    first = kept.where("id_ is not null").orderBy("id_", "v").limit(entries)
    rows = [r["v"] for r in first.collect()]
    if len({len(r) for r in rows}) > 1:
        rows = [r["v"] for r in kept.where(F.col("id_").isNotNull() & (F.size("v") == len(rows[0]))).orderBy("id_", "v").limit(entries).collect()]
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def one_round(state: DataFrame, books: np.ndarray) -> DataFrame:
    """state with each part's nearest entry in code, and the tasks' deltas as rows with a part.

    state: id_, label_, v, code (a short for each part, or null), and part, which is null.
    """
    import pyarrow as pa

    parts, entries, width = books.shape
    fields = state.schema
    names = ["id_", "label_", "v", "code", "part", "entry", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = Deltas(parts, entries, width)
        like = None
        for b in batches:
            v = matrix(b.column(2), parts * width)
            had = b.column(3)
            before = matrix(had, parts) if had.null_count == 0 else np.full((len(v), parts), -1)
            code = np.empty((len(v), parts), dtype=np.int16)
            for p in range(parts):
                mine = v[:, p * width : (p + 1) * width]
                code[:, p] = nearest(mine, books[p])[0]
                moved.move(p, mine, before[:, p], code[:, p].astype(np.int64))
            like = b
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * parts), pa.array(code.reshape(-1)))
            none = [pa.nulls(len(v), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), codes, *none], names=names)
        rows = moved.rows()
        if rows:
            none = [pa.nulls(len(rows), like.column(i).type) for i in (0, 1, 2)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(rows), pa.list_(pa.int16())), *columns], names=names)

    kinds = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in ("id_", "label_"))
    out = "v array<long>, code array<short>, part int, entry int, n long, sums array<long>"
    return state.select("id_", "label_", "v", "code").mapInArrow(run, f"{kinds}, {out}")


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """(id_, label_, code, error) of all vectors by the codebooks: two hex digits a part, and the squared distances' sum."""
    import pyarrow as pa

    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2), parts * width)
            both = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = ["".join(f"{x:02x}" for x in row) for row in zip(*(at.tolist() for at, _ in both))]
            error = sum((d for _, d in both), np.zeros(len(v), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error)], names=["id_", "label_", "code", "error"])

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("id_", "label_"))
    return state.select("id_", "label_", "v").mapInArrow(run, f"{kinds}, code string, error long")


def text_of(books: np.ndarray) -> str:
    """All entries' components as decimal integers, joined by commas, by part, entry and place."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None,
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(state, codebooks): the last round's table, with id_, label_ and v of every usable vector, and [part, entry, component].

    Usable vectors have finite components only, a length that is a multiple of `parts`, and the length of the
    first of them by id; others are left out. Rows without an id are coded, but none of the first entries; rows that
    share an id are each a vector. With fewer vectors than entries the codebooks are as short.
    """
    arrow_batches(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`")
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    kept = vectors.where(usable(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    kept = kept.select(F.col(f"`{id_col}`").alias("id_"), label.alias("label_"), whole(vector, scale).alias("v"))
    books = start(kept, entries, parts)
    state = kept.where(F.size("v") == parts * books.shape[2]).withColumn("code", F.lit(None).cast("array<short>"))
    if not books.size:
        return state.where("false"), books
    sums = table = None
    for _ in range(rounds):
        round_ = materialize(one_round(state, books), "lloyd")
        deltas = round_.where("part is not null").select("part", "entry", "n", "sums")
        total = materialize(added(deltas if sums is None else deltas.unionByName(sums)), "sums")
        discard(*(t for t in (sums, table) if t is not None))
        sums, table = total, round_
        state = round_.where("part is null").select("id_", "label_", "v", "code")
        for r in sums.where("n > 0").collect():  # at most one row for each entry of each part
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    if sums is not None:
        discard(sums)
    state.querent_path = table.querent_path if table is not None else None
    return state, books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every usable vector, by train()'s codebooks.

    Null vectors and such with null or non-finite components are left out; see train() for lengths and ids. label_error
    is the error summed over a label's vectors, those without a label together. An empty table gives an empty
    result; other columns aren't read. settings: those of train().
    """
    state, books = train(vectors, id_col, vector_col, label_col, **settings)
    kinds = {c: state.schema[c].dataType.simpleString() for c in ("id_", "label_")}
    if not books.size:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kinds['id_']}, code string, error long, label_error long, codebooks_sha256 string")
    found = materialize(coded(state, books), "codes")
    if state.querent_path:
        discard(state)
    by_label = found.groupBy("label_").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    by_label = materialize(by_label, "labels")
    both = lookup(found, by_label.drop("copies"), ["label_"], by_label.drop("label_error"))
    name = hashlib.sha256(text_of(books).encode()).hexdigest()
    return both.select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE) -> str:
    """DuckDB SQL for vector_codes() over embeddings of one length with distinct ids."""
    assign = """a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d FROM (
      SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN c{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
    update = """c{n} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN (
      SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))"""
    steps = [step.format(r=r, n=r + 1) for r in range(rounds) for step in (assign, update)] + [assign.format(r=rounds)]
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS v, len(embedding) // {parts} AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, CAST((pos - 1) // w AS INT) AS part, (pos - 1) % w AS pos, CAST(floor(CAST(v[pos] AS DOUBLE) * {scale}) AS BIGINT) AS x
      FROM (SELECT vec_id, v, w, unnest(range(1, len(v) + 1)) AS pos FROM k)),
    f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
    c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN f USING (vec_id)),
    {", ".join(steps)},
    e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
    h AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h"""
