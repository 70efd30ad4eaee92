"""Clusters around centroids, screened by the norms of blocks.

A vector is compressed to a byte a component and a scale; what that leaves of it is known by the norm of each of its
blocks. The product of a vector and a centroid is that of the compressed vector and what the rest adds, which by
Cauchy-Schwarz is at most the sum of the blocks' norms multiplied. That bounds the squared distance from below, and an
exact distance in integers is worked out only for centroids whose bound isn't above that of a first guess.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import arrow_batches, discard, materialize
from querent.llm.delta_lloyd import matrix, usable, whole

SCALE, DIMS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Components of a block.
BLOCK = 8
#: Bounds are lowered by this share of both squared norms, far beyond what rounding to 32 bits can add to them.
SLACK = 1e-5
#: Up to this size sums over 64 components are exact in 64 bits; beyond it Python's integers are used.
EXACT = 1 << 27
#: Pairs of a vector and a centroid whose exact distance is worked out at once.
PAIRS = 1 << 15


@dataclass
class Compressed:
    """Vectors (rows) as bytes times a scale, the norm of the rest in each block, and the squared norm of the whole."""

    codes: np.ndarray
    scale: np.ndarray
    rest: np.ndarray
    square: np.ndarray


def block_norms(v: np.ndarray, block: int) -> np.ndarray:
    """The norms of blocks of components; the last block may be shorter."""
    return np.sqrt(np.add.reduceat(v * v, np.arange(0, v.shape[1], block), axis=1))


def compressed(v: np.ndarray, block: int = BLOCK) -> Compressed:
    v = v.astype(np.float64)
    scale = np.abs(v).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1.0
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return Compressed(codes, scale, block_norms(v - scale[:, None] * codes, block).astype(np.float32), (v * v).sum(axis=1))


def bounds(short: Compressed, centres: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Lower bounds of the squared distances of compressed vectors (rows) and centroids (columns)."""
    c = centres.astype(np.float64)
    both = short.square[:, None] + (c * c).sum(axis=1)[None, :]
    product = short.scale[:, None] * (short.codes.astype(np.float64) @ c.T) + short.rest.astype(np.float64) @ block_norms(c, block).T
    return both - 2 * product - SLACK * both


def distances(v: np.ndarray, centres: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of v[rows] and centres[which]."""
    large = max(np.abs(v).max(initial=0), np.abs(centres).max(initial=0)) > EXACT
    out = np.empty(len(rows), dtype=object if large else np.int64)
    for i in range(0, len(rows), PAIRS):
        off = v[rows[i : i + PAIRS]] - centres[which[i : i + PAIRS]]
        out[i : i + PAIRS] = (off.astype(object) ** 2).sum(axis=1) if large else np.einsum("ij,ij->i", off, off)
    return out


def assign(v: np.ndarray, short: Compressed, centres: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, of equal ones the first; squared distance; exact distances worked out) of each row."""
    n = len(v)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    bound = bounds(short, centres, block)
    guess = bound.argmin(axis=1)
    every = np.arange(n)
    known = distances(v, centres, every, guess)
    open_ = bound <= known.astype(np.float64)[:, None] * (1 + 1e-12)
    open_[every, guess] = True
    rows, which = np.nonzero(open_)  # by row, then by centroid
    exact = distances(v, centres, rows, which)
    firsts = np.searchsorted(rows, every)
    best = np.minimum.reduceat(exact, firsts)
    hit = np.flatnonzero(exact == best[rows])
    first = hit[np.searchsorted(rows[hit], every)]
    return which[first], best.astype(np.int64), open_.sum(axis=1)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, block: int) -> DataFrame:
    """(v, codes, scale, square, rest, id_): the usable vectors in integers, and their compressed form, written once for
    all rounds."""
    import pyarrow as pa

    vector = F.col(f"`{vector_col}`")
    kept = vectors.where(usable(vector) & (F.size(vector) == dims)).select(whole(vector, scale).alias("v"), F.col(f"`{id_col}`").alias("id_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = compressed(matrix(b.column(0), dims), block)
            codes = pa.array([x.tobytes() for x in c.codes], pa.binary())
            ends = pa.array(np.arange(len(c.rest) + 1, dtype=np.int32) * c.rest.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), codes, pa.array(c.scale), pa.array(c.square), pa.ListArray.from_arrays(ends, pa.array(c.rest.reshape(-1))), b.column(1)], names=["v", "codes", "scale", "square", "rest", "id_"])

    return materialize(kept.mapInArrow(run, f"v array<long>, codes binary, scale double, square double, rest array<float>, id_ {kept.schema['id_'].dataType.simpleString()}"), "norms")


#: What a round reads of prepared().
SHORT = ["v", "codes", "scale", "square", "rest"]


def _batch(b, dims: int) -> tuple[np.ndarray, Compressed]:
    v = matrix(b.column(0), dims)
    codes = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int8).reshape(-1, dims)
    rest = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return v, Compressed(codes, b.column(2).to_numpy(), rest, b.column(3).to_numpy())


def sums(table: DataFrame, centres: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(cluster, at, n, total): each cluster's number of vectors and sums of components; tasks add up their own first."""
    import pyarrow as pa

    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for b in batches:
            v, short = _batch(b, dims)
            cluster = assign(v, short, centres, block)[0]
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        at = np.tile(np.arange(dims, dtype=np.int32), len(some))
        of = np.repeat(some, dims)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(at), pa.array(n[of]), pa.array(total[some].reshape(-1))], names=["cluster", "at", "n", "total"])

    parts = table.select(*SHORT).mapInArrow(run, "cluster int, at int, n long, total long")
    return parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS,
             rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact) for every vector of `dims` finite components.

    Other vectors are left out. The first centroids are the vectors whose sha256 of seed and id is smallest; rows that
    share an id are each a vector, in the order of their components; rows without an id are clustered, but no first
    centroid. With fewer vectors than k there are fewer centroids. n_exact is the number of exact distances that the
    bounds left over in the last assignment. An empty table gives an empty result; other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(vectors.sparkSession)
    table = prepared(vectors, id_col, vector_col, dims, scale, block)
    kind = table.schema["id_"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id_").cast("string")), 256)
    first = table.where("id_ is not null").select(order.alias("order_"), "v").orderBy("order_", "v").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact long")
    centres = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        for r in sums(table, centres, block).collect():  # dims rows for each centroid
            centres[r["cluster"], r["at"]] = r["total"] // r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, short = _batch(b, dims)
            cluster, distance, exact = assign(v, short, centres, block)
            yield pa.RecordBatch.from_arrays([b.column(5), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(exact.astype(np.int64))], names=["id_", "cluster", "distance", "n_exact"])

    found = table.select(*SHORT, "id_").mapInArrow(run, f"id_ {kind}, cluster int, distance long, n_exact long")
    found = materialize(found, "clusters")
    discard(table)
    sizes = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, sizes.get(i), sum(sizes.values()), digest(c)) for i, c in enumerate(centres)]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id_").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")


def sql(dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for clusters() over embeddings with distinct ids, without n_exact."""
    assign_ = """a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, struct_pack(d := d, e := cluster)) AS cluster, min(d) AS distance FROM (
      SELECT vec_id, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{r} USING (pos) GROUP BY ALL) GROUP BY ALL)"""
    update = """c{n} AS MATERIALIZED (SELECT cluster, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN (
      SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY ALL) USING (cluster, pos))"""
    steps = [step.format(r=r, n=r + 1) for r in range(rounds) for step in (assign_, update)] + [assign_.format(r=rounds)]
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, pos, CAST(floor(CAST(v[pos] AS DOUBLE) * {scale}) AS BIGINT) AS x FROM (SELECT vec_id, v, unnest(range(1, {dims + 1})) AS pos FROM k)),
    f AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INT) AS cluster FROM k ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}),
    c0 AS MATERIALIZED (SELECT cluster, pos, x AS c FROM x JOIN f USING (vec_id)),
    {", ".join(steps)},
    h AS (SELECT cluster, sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY ALL)
    SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (cluster)"""
