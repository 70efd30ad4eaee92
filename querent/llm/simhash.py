"""SimHash near-duplicates by a segment-popcount embedding.

Two 64-bit fingerprints that differ in d bits have per-segment bit counts that differ by at most d under
the Manhattan distance. So the counts are integer coordinates, fingerprints within the distance meet in a
grid cell next to both, and only those that meet are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import arrow_batches, dealt, discard, materialize, new_path, running, small
from querent.llm.components import components

#: Bits of a segment; the embedding has 64 / SEGMENT coordinates of 0 to SEGMENT.
SEGMENT = 4
#: Links join fingerprints with at most this many differing bits; the midpoint argument below needs 2.
DISTANCE = 2
#: Fingerprints with more than one in so many of all rows count as hot; there can't be more than this.
HOT_GROUPS = 10_000
#: For links by similarity: words of a shingle, and 64-bit numbers of a text's sketch.
SIMILAR_WORDS, SKETCH = 5, 32
#: Shingles that are frequent come last in the order by which texts are looked up. They are found in one of so many
#: texts, where they occur in so many or more; of more than HOT_SHINGLES the most frequent.
SAMPLED, HOT_AT, HOT_SHINGLES = 16, 4, 200_000
#: Buckets of up to so many different texts are compared in all pairs of rows; fuller ones by blocks of about so many.
PAIRED = 64
BLOCK = 1024


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of one text: A-Z lower-cased, words between ASCII white space, shingles of
    `width` words with repeats, XXH64 with seed 42. Fewer words: the whole sequence; none: zero."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    n = len(shingles)
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):  # bounds the unpacked bits of very long texts
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for every row; other columns are not read. Null and blank texts have fingerprint zero."""
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def cell(fp: F.Column, segment: int = SEGMENT) -> F.Column:
    """The embedding packed into one number: the bit count of each segment, three bits each."""
    out = F.lit(0).cast("long")
    for i in range(64 // segment):
        out = out + F.shiftleft(_count(fp, i, segment).cast("long"), 3 * i)
    return out


def _count(fp: F.Column, i: int, segment: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned(fp, i * segment).bitwiseAND(F.lit((1 << segment) - 1).cast("long")))


def _ball(segment: int = SEGMENT) -> F.Column:
    """Cells at Manhattan distance 0 and 1 of column `cell` (a fingerprint's own), as an array."""
    around = [F.col("cell")]
    for i in range(64 // segment):
        here = F.shiftrightunsigned("cell", 3 * i).bitwiseAND(F.lit(7).cast("long"))
        step = F.lit(1 << (3 * i)).cast("long")
        around += [F.when(here > 0, F.col("cell") - step), F.when(here < segment, F.col("cell") + step)]
    return F.array_compact(F.array(*around))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, whose components equal those of all pairs of distinct fingerprints within 2 bits.

    fps: one column fp without repeats. Each fingerprint goes to the cells at distance 0 and 1 of its own;
    two within Manhattan distance 2 share one of them. A cell with two members is verified at once. Members
    of fuller cells are verified through the 65 numbers within one bit of each: two fingerprints within two
    bits share such a number, and those that share one are within two bits, so a number has at most 65
    members and gives a star of links. Nothing is paired within a group; the work stays in proportion to
    the number of fingerprints, however alike they are.
    """
    spread = fps.select("fp", cell(F.col("fp")).alias("cell")).select("fp", F.explode(_ball()).alias("key"))
    met = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    met = materialize(met, "cells", new_path(fps.sparkSession, "cells"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = met.where("n = 2").where(near).select("a", "b")
    full = met.where("n > 2").select("key")
    dense = spread.join(small(full), "key", "left_semi").select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    middle = dense.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid"))
    stars = (
        middle.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    )
    return pairs.union(stars).distinct()


def shingle_set(text: str | None, width: int = SIMILAR_WORDS):
    """The distinct hashes of a text's shingles, rising; words as for fingerprint()."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter((xxh64_intdigest(s, 7) for s in shingles), dtype=np.uint64))


def sketch(hashes):
    """SKETCH numbers with a bit for each of as many groups of hashes: whether it has an odd number of them. Two sets
    differ in at least as many hashes as their sketches do in bits."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def with_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """fingerprints() with what is known of the set of shingles of each text: `sid`, a hash of it (null without words),
    its size `n`, its `sketch`, and for one in SAMPLED sets, once a task, the set itself as `sample`."""
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()

        def sample(sid: int | None, hashes):
            if sid is None or sid % SAMPLED or sid in done:
                return None
            done.add(sid)
            return hashes.view("<i8")

        for b in batches:
            texts = b.column(1).to_pylist()
            fps = pa.array([fingerprint(t, width) for t in texts], pa.int64())
            sets = [shingle_set(t) for t in texts]
            sids = [set_id(x) for x in sets]
            columns = [
                fps, pa.array(sids, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([sketch(x) for x in sets], longs),
                pa.array([sample(i, x) for i, x in zip(sids, sets)], longs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "fp", "sid", "n", "sketch", "sample"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long, sid long, n int, sketch array<long>, sample array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, own): the sets of shingles of the texts with these ids, sorted; a set may come several times."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), pa.array([x.view("<i8") for x in sets], pa.list_(pa.int64()))], names=["sid", "own"])

    wanted = docs.select(id_col, text_col).join(small(ids), F.col(id_col).eqNullSafe(F.col("least_")), "left_semi").select(text_col)
    return wanted.mapInArrow(run, "sid long, own array<long>").where("sid is not null")


def set_id(hashes) -> int | None:
    """A signed 64-bit hash of a set of shingles; None for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return None
    h = xxh64_intdigest(hashes.tobytes(), 11)
    return h - (1 << 64) if h >> 63 else h


def frequent_shingles(fps: DataFrame):
    """At most HOT_SHINGLES hashes, rising, that occur in HOT_AT or more of one in SAMPLED distinct sets, and the rank of
    each by how often that is."""
    import numpy as np

    some = fps.where("sample is not null").select("sid", "sample").dropDuplicates(["sid"])
    often = some.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_AT)
    got = often.orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).toArrow()
    token, n = got.column("token").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((token, n))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order))
    rising = np.argsort(token)
    return token[rising], rank[rising]


def prefix(hashes, hot, similarity: float, rank=None):
    """The first shingles of a set, frequent ones last (by their rank, if it is known), else by hash: two sets of the
    similarity share one of these."""
    import numpy as np

    n = len(hashes)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    own = np.sort(hashes)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        last = hot[at] == own
        often = own[last] if rank is None else own[last][np.argsort(rank[at[last]])]
        own = np.concatenate((own[~last], often))
    return own[:size]


def _spread(docs: DataFrame, hot, similarity: float, text_col: str) -> DataFrame:
    """(token, sid, n, pos) of each set's prefix: the shingle, the set and its size, the shingle's place in its order.
    A set comes once a task."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        done: set[int | None] = {None}
        for b in batches:
            columns: list[list] = [[], [], [], []]
            for text in b.column(0).to_pylist():
                hashes = shingle_set(text)
                sid = set_id(hashes)
                if sid in done:
                    continue
                done.add(sid)
                tokens = prefix(hashes.view("<i8"), shared.value[0], similarity, shared.value[1])
                for c, v in zip(columns, (tokens, np.full(len(tokens), sid), np.full(len(tokens), len(hashes)), np.arange(len(tokens)))):
                    c.append(v)
            arrays = [np.concatenate([*c, np.zeros(0, dtype=np.int64)]).astype(np.int64) for c in columns]
            for at in range(0, len(arrays[0]), 1 << 17):
                part = [pa.array(x[at : at + (1 << 17)]) for x in arrays]
                yield pa.RecordBatch.from_arrays([part[0], part[1], part[2].cast(pa.int32()), part[3].cast(pa.int32())], names=["token", "sid", "n", "pos"])

    return docs.select(text_col).mapInArrow(run, "token long, sid long, n int, pos int")


def similar_links(docs: DataFrame, fps: DataFrame, near: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) of fingerprints whose components equal those of `near` and of all pairs of texts with at least this
    Jaccard similarity of SIMILAR_WORDS-word shingles.

    fps: with_sets() of docs. The nodes are distinct sets of shingles, whatever their fingerprints;
    a set's first fingerprint stands for it, and its others are linked to that one. Shingles have an order, frequent
    ones last. Two sets of the similarity share one of their first shingles, and where they first do enough has to be
    left of both for the overlap they need; so no pair is missed, and few others are looked at. Of buckets of
    up to PAIRED sets all such pairs are made; those that sizes and sketches don't rule out are verified on
    whole sets, each set's likeliest pair first, and then those that aren't in one component yet. In larger ones each set
    is verified with the first and the last, and then the sets that are still apart are compared in blocks, see _apart.
    """
    texts = fps.where("sid is not null").groupBy("sid").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.min(id_col).alias("least"))
    texts = materialize(texts, "texts")
    many_fps = texts.where("fp <> other").select("sid", F.col("fp").alias("a"))
    same = fps.select("sid", F.col("fp").alias("b")).distinct().join(small(many_fps), "sid").select("a", "b").where("a <> b")
    share = similarity / (1 + similarity)
    spread = materialize(_spread(docs, frequent_shingles(fps), similarity, text_col), "spread")
    met = spread.groupBy("token").agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.min("n").alias("least")).where("first <> last").select("token", "least")
    reach = (F.col("n") - F.col("pos")) / F.lit(share) - F.col("n") + 1e-6  # sizes that a set can meet here
    own = spread.join(met, "token").where(F.col("least") <= reach).select("token", "sid", "n", "pos").distinct()
    own = materialize(own, "buckets")
    discard(spread)
    sizes = own.groupBy("token").agg(F.count("*").alias("members"), F.min("sid").alias("first"), F.max("sid").alias("last")).where("members > 1")
    sizes = materialize(sizes, "sizes")
    few = own.join(sizes.where(F.col("members") <= PAIRED).select("token"), "token", "left_semi").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "pos"))).alias("all"))
    enough = lambda a, b: F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= share * (a["n"] + b["n"]) - 1e-6
    both = lambda a, i: F.transform(F.filter(F.slice("all", i + 2, PAIRED), lambda b: enough(a, b)), lambda b: F.struct(a["sid"].alias("a"), b["sid"].alias("b")))
    pairs = few.select(F.explode(F.flatten(F.transform("all", both))).alias("p")).select("p.a", "p.b")
    crowded = sizes.where(F.col("members") > PAIRED)
    full = materialize(own.join(small(crowded), "token").select(F.col("token").alias("key"), "sid", "n", "pos", "first", "last"), "full")
    ends = full.select("sid", F.explode(F.array("first", "last")).alias("end")).where("sid <> end").select(F.least("sid", "end").alias("a"), F.greatest("sid", "end").alias("b"))
    pairs = materialize(pairs.union(ends).distinct(), "pairs")
    discard(own, sizes)
    meta = lambda side, f, n, x: texts.select(F.col("sid").alias(side), F.col("fp").alias(f), F.col("n").alias(n), F.col("sketch").alias(x))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    likely = pairs.join(meta("a", "fa", "na", "x"), "a").join(meta("b", "fb", "nb", "y"), "b").where("fa <> fb").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6).where(differ <= most)
    near = materialize(near.union(same), "near")
    likely = materialize(_between(likely.select("a", "b", "fa", "fb", differ.alias("differ")), near), "likely")
    discard(pairs)

    def sets_of(sids: DataFrame) -> DataFrame:
        ids = materialize(sids.distinct().join(texts.select("sid", F.col("least").alias("least_")), "sid").select("least_").distinct(), "wanted")
        return materialize(whole_sets(docs, ids, id_col, text_col), "shingles")

    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("sid")))
    common = F.size(F.array_intersect("x", "y"))

    def verified(some: DataFrame) -> DataFrame:
        met_sets = some.join(sets.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
        counted = met_sets.select(F.col("fa").alias("a"), F.col("fb").alias("b"), common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
        return counted.where(F.col("c") >= similarity * (F.col("s") - F.col("c"))).select("a", "b")

    best = likely.select(F.explode(F.array("a", "b")).alias("sid"), "differ", "a", "b", "fa", "fb").groupBy("sid").agg(F.min(F.struct("differ", "a", "b", "fa", "fb")).alias("m")).select("m.*").drop("differ").distinct()
    edges = materialize(near.union(verified(materialize(best, "best"))), "edges")
    rest = materialize(_between(likely, edges), "rest")
    edges = materialize(edges.union(verified(rest.select("a", "b", "fa", "fb"))), "edges")
    if full.isEmpty():
        return edges
    roots = materialize(components(edges), "roots")
    discard(sets)
    edges = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    left = _apart(full.select("key", "sid", "n", "pos"), texts.select("sid", "fp", "sketch"), roots, similarity)
    if left is None or left.isEmpty():
        return edges
    return edges.union(_joined(left, sets_of(left.select("sid")), similarity))


def _between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of pairs (…, fa, fb) whose fingerprints are in different components of the edges."""
    roots = components(edges)
    side = lambda f, r: roots.select(F.col("node").alias(f), F.col("root").alias(r))
    met = pairs.join(side("fa", "ra"), "fa", "left").join(side("fb", "rb"), "fb", "left")
    return met.where(F.coalesce("ra", "fa") != F.coalesce("rb", "fb")).select(pairs.columns)


def _apart(full: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame | None:
    """(pair, side, sid, fp, root): the members of pairs of blocks that may have the similarity with one of the other side
    and aren't in its component of `roots`; None if there are none. full: (key, sid, n, pos), the crowded buckets.

    A bucket that is one component is done. In the others sets are put in order by component (if it is large), by the
    first crowded shingle that they have, and by size, and cut into blocks of BLOCK. Two sets are compared in one bucket
    only: if both have the same first crowded shingle, in that one. Two blocks are left out if that, their component or
    their sizes leave nothing to compare; in others each set's sketch is held against all of the other's, and only
    sets that neither the sketch nor the size nor the place of the shingle rules out go on.
    """
    import pyarrow as pa

    first = full.groupBy("sid").agg(F.min(F.struct("pos", "key")).alias("f")).select("sid", F.col("f.key").alias("lead"))
    member = full.join(first, "sid").join(texts, "sid").join(roots, F.col("fp") == roots["node"], "left")
    member = member.select("key", "sid", "fp", "n", (F.col("n") - F.col("pos")).alias("left"), "lead", "sketch", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    each = materialize(member.groupBy("key", "root").agg(F.count("*").alias("m")), "each")
    mixed = materialize(each.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1").select("key"), "mixed")
    if mixed.isEmpty():
        return None
    large = materialize(each.where(F.col("m") >= BLOCK).select("key", "root", F.col("root").alias("owner")), "owners")
    open_ = member.join(small(mixed), "key", "left_semi").join(small(large), ["key", "root"], "left").withColumn("owner", F.coalesce("owner", F.lit(0)))
    order = ["owner", "lead", "n", "sid"]
    placed = running(dealt(open_, ["key"], order, "ordered"), ["key"], [F.col(c) for c in order], "at")
    placed = materialize(placed.withColumn("block", F.floor(F.col("at") / BLOCK)).drop("at", "owner"), "placed")
    span = [f(c).alias(f"{f.__name__}_{c}") for c in ("root", "lead", "n") for f in (F.min, F.max)]
    blocks = materialize(placed.groupBy("key", "block").agg(*span, F.max("left").alias("left")), "blocks")
    share = similarity / (1 + similarity)
    p, q = (blocks.select(F.col("key").alias(f"{s}key"), *(F.col(c).alias(s + c) for c in blocks.columns if c != "key")) for s in "pq")
    alone = lambda c: (F.col(f"pmin_{c}") == F.col(f"pmax_{c}")) & (F.col(f"qmin_{c}") == F.col(f"qmax_{c}")) & (F.col(f"pmin_{c}") == F.col(f"qmin_{c}"))
    met = p.join(q, F.col("pkey") == F.col("qkey")).where("pblock <= qblock").where(~alone("root") & ~(alone("lead") & (F.col("pmin_lead") != F.col("pkey"))))
    met = met.where(F.least("pleft", "qleft") >= share * (F.col("pmin_n") + F.col("qmin_n")) - 1e-6)
    met = met.where((F.col("pmin_n") * similarity <= F.col("qmax_n") + 1e-6) & (F.col("qmin_n") * similarity <= F.col("pmax_n") + 1e-6))
    met = met.select("pkey", F.concat_ws("|", F.col("pkey").cast("string"), F.col("pblock").cast("string"), F.col("qblock").cast("string")).alias("pair"), "pblock", "qblock")
    sides = met.select(F.col("pkey").alias("key"), "pair", F.col("pblock").alias("block"), F.lit(0).alias("side"))
    sides = sides.union(met.where("pblock <> qblock").select("pkey", "pair", "qblock", F.lit(1)))
    given = placed.join(sides, ["key", "block"]).select("pair", "side", "key", "sid", "fp", "root", "n", "left", "lead", "sketch")

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        side, sid, root, n, left, lead, key = (table.column(c).to_numpy() for c in ("side", "sid", "root", "n", "left", "lead", "key"))
        bits = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sid), -1)
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        keep = np.zeros(len(sid), dtype=bool)
        for i in a.tolist():
            total = n[i] + n[b]
            may = (root[b] != root[i]) & ((lead[b] != lead[i]) | (lead[b] == key[b])) & (np.minimum(left[i], left[b]) >= share * total - 1e-6)
            to = b[may]
            if len(to):
                differ = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
                to = to[differ <= (1 - similarity) / (1 + similarity) * total[may] + 1e-6]
                keep[to] = True
                keep[i] |= len(to) > 0
        return table.filter(pa.array(keep)).select(["pair", "side", "sid", "fp", "root"])

    return materialize(given.groupBy("pair").applyInArrow(run, "pair string, side int, sid long, fp long, root long"), "left")


def _joined(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between components, from all pairs of sets of the similarity on both sides of each pair of blocks.

    Common shingles of all pairs of a group are a matrix product. A group's edges are a forest, so they are fewer
    than its sets.
    """
    import pyarrow as pa

    given = left.join(sets.dropDuplicates(["sid"]), "sid").select("pair", "side", "fp", "root", "own")

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        side, fp, root = (table.column(c).to_numpy() for c in ("side", "fp", "root"))
        size = table.column("own").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(size)), size)
        _, at, times = np.unique(table.column("own").combine_chunks().flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[at] > 1
        of, at = of[shared], (np.cumsum(times > 1) - 1)[at][shared]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        common = np.zeros((len(a), len(b)), dtype=np.float32)  # of whole numbers below 2^24
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            some = slice(*np.searchsorted(at, [low, low + 4096]))
            held = np.zeros((len(size), 4096), dtype=np.float32)
            held[of[some], at[some] - low] = 1
            common += held[a] @ held[b].T
        alike = (common >= similarity * (size[a][:, None] + size[b] - common.astype(float))) & (root[a][:, None] != root[b])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(alike))):
            x, y = find(int(root[a[i]])), find(int(root[b[j]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(fp[a[i]]), int(fp[b[j]])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return given.groupBy("pair").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None,
) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the smallest id among documents that can be reached over links of at most 2 differing
    bits, the document itself included. With `similarity`, texts of that Jaccard similarity link as well (see
    similar_links). Nulls: a null or blank text has fingerprint zero and links like any other; a null id is
    never the smallest unless its whole component has none. Repeated rows stay, ties go to the smallest id, an
    empty table gives an empty result, further columns of docs are ignored.
    """
    prints = fingerprints(docs, id_col, text_col, width) if similarity is None else with_sets(docs, id_col, text_col, width)
    fps = materialize(prints, "fingerprints")
    unique = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "unique")
    edges = links(unique.select("fp"))
    if similarity is not None:
        edges = similar_links(docs, fps, edges, similarity, id_col, text_col)
    fps = fps.select(id_col, "fp")
    roots = components(edges)
    named = unique.join(roots, unique["fp"] == roots["node"]).groupBy("root").agg(F.min("least").alias("named"))
    changed = roots.join(named, "root").select(F.col("node").alias("fp"), "named")
    every = materialize(unique.join(changed, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), "copies"), "named")
    # at most HOT_GROUPS fingerprints hold more than this share of the rows: they are broadcast, and their rows
    # go anywhere in the join that names the others
    many = (every.agg(F.sum("copies")).first()[0] or 0) / HOT_GROUPS
    hot = every.where(F.col("copies") > many).select("fp", F.col("component_id").alias("hot_"))
    cold = every.where(F.col("copies") <= many).select(F.col("fp").alias("to_"), F.col("component_id").alias("cold_"))
    known = fps.join(F.broadcast(hot), "fp", "left")
    dealt = known.withColumn("to_", F.when(F.col("hot_").isNotNull(), F.xxhash64(id_col)).otherwise(F.col("fp")))
    return dealt.join(cold, "to_", "left").select(id_col, "fp", F.coalesce("hot_", "cold_").alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None,
) -> DataFrame:
    """docs without those rows whose component has a smaller id; columns as they came.

    Rows that share an id are one document and stay or go together; rows with a null id stay. Null and blank texts
    are near-duplicates of each other; an empty table gives an empty one; further columns may have any names.
    """
    found = near_duplicates(docs, id_col, text_col, width, similarity)
    gone = materialize(found.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct(), "gone")
    return docs.join(small(gone), id_col, "left_anti").select(docs.columns)
