"""Chroma fingerprints of audio: pitch-class frames, integral-image filters, packed integers, alignment by offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import arrow_batches, lookup, materialize

#: Samples of a frame and between frames, as shares of a second, and the frequencies that count.
FRAME_S, HOP_S = 0.256, 0.128
LOW_HZ, HIGH_HZ = 100.0, 960.0
#: Sixteen filters of two bits: kind, first pitch class, height, width in frames; made by a rule below.
FILTERS = 16
WIDEST = 12
#: Quantiser limits of a filter's log ratio.
LIMITS = (-0.18, 0.0, 0.18)
#: A pair of recordings aligns at an offset if over at least LEAST_OVERLAP integers at most this share of the bits differ.
LEAST_OVERLAP = 16
MOST_ERRORS = 0.15
#: Every recording whose id is divisible by this is looked for among all.
QUERY_EVERY = 20
#: Codes of a block of recordings that are looked for, and of a block of those they are looked for in.
QUERY_CODES, BLOCK_CODES = 1 << 18, 1 << 20
#: Two codes vote for their offset if at most so many bits differ. Errors can't be above their average everywhere, so
#: wherever two recordings align at least one integer votes.
NEAR = int(32 * MOST_ERRORS)
#: Codes are looked up by two parts of their bits, (first bit, bits, bits that may differ): if more differ in both, more
#: than NEAR differ. The longer part may differ in more, which leaves the fewest codes to compare.
PARTS = ((0, 18, NEAR // 2), (18, 14, NEAR - NEAR // 2 - 1))
#: A vote counts if another integer so far away in both recordings agrees as well: (places away, bits of both together
#: that may differ). Integers that far apart share few frames, so hardly any vote of chance has another one beside it.
PARTNERS = ((LEAST_OVERLAP // 2, int(64 * MOST_ERRORS)), (-(LEAST_OVERLAP // 2), int(64 * MOST_ERRORS)), (LEAST_OVERLAP // 2 * 2, 2 * NEAR))
#: Votes that are looked at together, pairs of codes that are compared at once (as many as a processor's cache holds), and
#: how many of them cost as much as two recordings at one offset.
VOTES, AT_ONCE, WORTH = 1 << 18, 1 << 16, 2


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of each filter: all kinds, spread over pitch classes and widths."""
    return [(i % 6, (5 * i) % 9, 2 + i % 3, (3, 5, 8, 12)[i % 4]) for i in range(FILTERS)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of 12 pitch-class energies (rows), each scaled to length one; silence is zero."""
    size, hop = 1 << round(np.log2(FRAME_S * rate)), 1 << round(np.log2(HOP_S * rate))
    if len(samples) < size:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), size)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(size).astype(np.float32), axis=1)) ** 2
    hz = np.fft.rfftfreq(size, 1 / rate)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    out = power[:, used] @ (pitch[:, None] == np.arange(12)).astype(np.float32)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(length > 1e-6, out / np.maximum(length, 1e-6), 0.0)


def codes(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each run of WIDEST frames, by filters on the integral image of the frames."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        """Sums of frames at+x0 to at+x1 and pitch classes y0 to y1, ends exclusive."""
        return image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, height, width in filters():
        x, top, half, mid = width // 2, y + height, y + height // 2, width // 3
        if kind == 0:
            a, b = area(0, width, y, top), None
        elif kind == 1:
            a, b = area(0, width, half, top), area(0, width, y, half)
        elif kind == 2:
            a, b = area(x, width, y, top), area(0, x, y, top)
        elif kind == 3:
            a, b = area(0, x, half, top) + area(x, width, y, half), area(0, x, y, half) + area(x, width, half, top)
        elif kind == 4:
            a, b = area(mid, 2 * mid, y, top), area(0, mid, y, top) + area(2 * mid, width, y, top)
        else:
            a, b = area(0, width, y, top), area(0, width, 0, 12) / 12 * height
        value = np.log1p(np.maximum(a, 0)) - (np.log1p(np.maximum(b, 0)) if b is not None else np.log1p(width * height / 12))
        level = sum((value > limit).astype(np.uint32) for limit in LIMITS)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out.view(np.int32)


def fingerprints(media: DataFrame, rate: int, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """(id, codes) for recordings of little-endian signed 16-bit samples, of any length; null or short ones have no
    codes, repeated rows stay, an empty table gives an empty result, other columns aren't read."""
    import pyarrow as pa

    arrow_batches(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codes(chroma(np.frombuffer(raw or b"", dtype="<i2", count=len(raw or b"") // 2), rate)) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "codes"])

    return media.select(id_col, pcm_col).mapInArrow(run, f"`{id_col}` {kind}, codes array<int>")


def align(prints: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per recording: id, class_id, n_codes, is_query, n_links, best_class, best_offset, best_errors.

    Recordings with equal codes form a class, named by its smallest id. Every class that has an id divisible
    by QUERY_EVERY is looked for among all others. Two codes of which at most NEAR bits differ vote for the
    offset at which they meet, if one of their PARTNERS agrees; every offset with a vote and LEAST_OVERLAP integers is
    verified by the share of differing bits over the whole overlap. n_links counts the classes that align, best_ is the one
    with the fewest errors (then the smallest class, then offset); offset is the other's position less the
    query's. Both are null for classes without query or link. Copies are never paired with each other, so their
    number doesn't matter.

    All classes are indexed, in blocks, and the query classes are looked up in each block. No alignment is missed.
    Deal the integers of the overlap to LEAST_OVERLAP / 2 rows, each of every so many-th integer; one row, of m >= 2
    integers, has a share of at most MOST_ERRORS, 4.8 bits an integer. Either two neighbours in the row have at most 9
    wrong bits together, so one of them at most NEAR; or each two have 10 or more, so m is odd (an even row would have
    5 m), and as the others make neighbours, its first and third integer have at most 4.8 m - 5 (m - 1) < 5, that is
    NEAR each. An integer of at most NEAR wrong bits has at most as many in one of its PARTS as are looked up there.

    Null or empty codes are a class that aligns with nothing; ids keep their type, of which those that are no
    whole numbers are no queries and null is never the smallest; repeated rows stay; an empty table gives an
    empty result; other columns aren't read.
    """
    kind = prints.schema[id_col].dataType
    key = F.xxhash64(F.transform("codes", lambda x: x.cast("long")))
    own = materialize(prints.select(F.col(id_col).alias("id"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes")).withColumn("key", key), "codes")
    asks = F.coalesce(F.expr("try_cast(id as bigint)") % QUERY_EVERY == 0, F.lit(False))
    classes = own.groupBy("key").agg(F.min("id").alias("class"), F.max(asks).alias("asks"), F.first("codes").alias("codes"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    long = classes.where(F.size("codes") >= LEAST_OVERLAP).select("key", "codes", "asks")
    total, asked = long.agg(F.sum(F.size("codes")), F.sum(F.when(F.col("asks"), F.size("codes")))).first()
    n_r, n_q = -(-(total or 1) // BLOCK_CODES), -(-(asked or 1) // QUERY_CODES)
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = long.where("asks").select("key", "codes", block(n_q).alias("q_block"), every(n_r).alias("r_block"), F.lit(0).alias("side"))
    right = long.select("key", "codes", every(n_q).alias("q_block"), block(n_r).alias("r_block"), F.lit(1).alias("side"))
    dealt = left.union(right).repartition(4 * n_q * n_r, "q_block", "r_block")  # a number of its own, else few tasks get all blocks
    met = dealt.groupBy("q_block", "r_block").applyInArrow(_compare, "q long, r long, errors double, offset long")
    good = materialize(met, "links")
    names = classes.select(F.col("key").alias("r"), F.col("class").alias("best_class"))
    best = good.join(names, "r").groupBy("q").agg(F.count("*").alias("n_links"), F.min(F.struct("errors", "best_class", "offset")).alias("best"))
    named = classes.join(best, classes["key"] == best["q"], "left").select("key", "class", "asks", "n_links", "best")
    return lookup(own, named, ["key"], classes.select("key", "copies")).select(
        F.col("id").alias(id_col), F.col("class").cast(kind).alias("class_id"), F.size("codes").cast("long").alias("n_codes"), F.col("asks").alias("is_query"),
        F.when(F.col("asks"), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.col("best.best_class").alias("best_class"),
        F.col("best.offset").cast("long").alias("best_offset"), F.col("best.errors").alias("best_errors"),
    )


class Recordings:
    """Codes of many recordings, end to end."""

    def __init__(self, names: np.ndarray, codes: list[np.ndarray]):
        self.names, self.codes = names, codes
        self.size = np.array([len(c) for c in codes], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*codes, np.zeros(0, dtype=np.uint32)])
        self.owner = np.repeat(np.arange(len(codes)), self.size)
        self.place = np.arange(len(self.flat)) - np.repeat(self.start, self.size)


def _masks(bits: int, ones: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= ones]


def _compare(table):
    """For recordings of side 0 (queries) and 1: the best offset of each pair of different ones that aligns."""
    import pyarrow as pa

    codes = table.column("codes").combine_chunks()
    ends, flat = codes.offsets.to_numpy(), codes.values.to_numpy().view(np.uint32)
    side, key = table.column("side").to_numpy(), table.column("key").to_numpy()
    q, r = (Recordings(key[side == k], [flat[ends[i] : ends[i + 1]] for i in np.flatnonzero(side == k)]) for k in (0, 1))
    found = align_block(q, r)
    return pa.table({"q": pa.array(q.names[found[0]]), "r": pa.array(r.names[found[1]]), "errors": pa.array(found[2]), "offset": pa.array(found[3])})


def align_block(q: Recordings, r: Recordings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, errors, offset) of the pairs that align, by place in q and r, each pair at its best offset.

    Queries with more pairs of codes to compare than it takes to try all offsets are compared at all offsets, which gives
    the same pairs.
    """
    index, votes = [], np.zeros(len(q.flat), dtype=np.int64)
    own, theirs = _beside(q, ~q.flat), _beside(r, r.flat)  # two that lack a partner never agree
    for shift, bits, ones in PARTS:
        masks = _masks(bits, ones)
        part = (r.flat >> np.uint32(shift)) & np.uint32((1 << bits) - 1)
        ends = np.concatenate([[0], np.bincount(part, minlength=1 << bits).cumsum()])
        mine = (q.flat >> np.uint32(shift)) & np.uint32((1 << bits) - 1)
        values, which = np.unique(mine, return_inverse=True)
        size = np.zeros(len(values), dtype=np.int64)
        for mask in masks:
            size += ends[(values ^ mask) + 1] - ends[values ^ mask]
        votes += size[which]
        order = np.argsort(part)
        index.append((theirs.take(order, axis=1), order, ends, mine, masks))
    by_query = np.bincount(q.owner, weights=votes, minlength=len(q.codes))
    crowded = by_query > WORTH * (len(r.flat) + len(r.codes) * q.size)
    out = [_everywhere(int(i), q, r) for i in np.flatnonzero(crowded)]
    posts = np.flatnonzero(~crowded[q.owner]) if len(q.flat) else np.zeros(0, dtype=np.int64)
    waiting, n_waiting = [], 0
    for some in index:
        for asker, hit in _near(own, posts, *some):
            waiting.append((asker, hit))
            n_waiting += len(hit)
            if n_waiting >= VOTES:
                out.append(_verified(*_offsets(waiting, q, r), q, r))
                waiting, n_waiting = [], 0
    if waiting:
        out.append(_verified(*_offsets(waiting, q, r), q, r))
    a, b, errors, offset = (np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(4))
    a, b, offset = a.astype(np.int64), b.astype(np.int64), offset.astype(np.int64)
    apart = q.names[a] != r.names[b]
    a, b, errors, offset = a[apart], b[apart], errors[apart], offset[apart]
    order = np.lexsort((offset, errors, b, a))
    a, b, errors, offset = a[order], b[order], errors[order], offset[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], errors[first].astype(float), offset[first]


def _beside(x: Recordings, lacking: np.ndarray) -> np.ndarray:
    """Columns of all codes and of each of their PARTNERS, of which those outside the recording are `lacking`."""
    out = np.repeat(lacking[None, :], 1 + len(PARTNERS), axis=0)
    out[0] = x.flat
    for k, (away, _) in enumerate(PARTNERS, 1):
        there = np.flatnonzero((x.place + away >= 0) & (x.place + away < np.repeat(x.size, x.size)))
        out[k, there] = x.flat[there + away]
    return out


def _near(own: np.ndarray, posts: np.ndarray, posted: np.ndarray, order: np.ndarray, ends: np.ndarray, mine: np.ndarray, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in own, place in order) of those that agree with a partner, of columns of _beside() with parts that are near
    enough.

    Queries' codes with the same part meet the same codes of the index, so these are brought together once and compared
    with all of them.
    """
    posts = posts[np.argsort(mine[posts], kind="stable")]
    values, start = np.unique(mine[posts], return_index=True)
    for value, some in zip(values, np.split(posts, start[1:])):
        low, high = ends[value ^ masks], ends[(value ^ masks) + 1]
        times = high - low
        at = np.repeat(high - times.cumsum(), times)
        at += np.arange(len(at))
        theirs, mines = posted.take(at, axis=1), own[:, some, None]
        for j in range(0, len(at), AT_ONCE):
            across = theirs[:, j : j + AT_ONCE]
            rows = max(1, AT_ONCE // across.shape[1])
            for i in range(0, len(some), rows):
                wrong = np.bitwise_count(mines[0, i : i + rows] ^ across[0])
                agree = np.zeros(wrong.shape, dtype=bool)
                for k, (_, most) in enumerate(PARTNERS, 1):
                    agree |= wrong + np.bitwise_count(mines[k, i : i + rows] ^ across[k]) <= most
                found = np.flatnonzero(agree)
                if len(found):
                    row, column = np.divmod(found, across.shape[1])
                    yield some[i + row], order[at[j + column]]


def _offsets(votes: list[tuple[np.ndarray, np.ndarray]], q: Recordings, r: Recordings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, offset) of the votes (place in q, place in r) of which a partner within both recordings agrees, each once."""
    asker, hit = (np.concatenate(x) for x in zip(*votes))
    wrong, fine = np.bitwise_count(q.flat[asker] ^ r.flat[hit]), np.zeros(len(hit), dtype=bool)
    for away, most in PARTNERS:
        there = np.ones(len(hit), dtype=bool)
        for x, at in ((q, asker), (r, hit)):
            there &= (x.place[at] + away >= 0) & (x.place[at] + away < x.size[x.owner[at]])
        there = np.flatnonzero(there)
        fine[there] |= wrong[there] + np.bitwise_count(q.flat[asker[there] + away] ^ r.flat[hit[there] + away]) <= most
    asker, hit = asker[fine], hit[fine]
    pair, offset = q.owner[asker] * len(r.codes) + r.owner[hit], r.place[hit] - q.place[asker]
    order = np.lexsort((offset, pair))  # a histogram of offsets for each pair
    pair, offset = pair[order], offset[order]
    first = np.ones(len(pair), dtype=bool)
    first[1:] = (pair[1:] != pair[:-1]) | (offset[1:] != offset[:-1])
    return pair[first] // len(r.codes), pair[first] % len(r.codes), offset[first]


def _verified(a: np.ndarray, b: np.ndarray, offset: np.ndarray, q: Recordings, r: Recordings) -> tuple[np.ndarray, ...]:
    """Those of the given pairs and offsets that align. What is over the limit on the way is left out, as errors add up."""
    low = np.maximum(0, -offset)
    n = np.minimum(q.size[a] - low, r.size[b] - low - offset)
    x, y = q.start[a] + low, r.start[b] + low + offset
    at, wrong = np.flatnonzero(n >= LEAST_OVERLAP), np.zeros(len(a), dtype=np.int64)
    most = np.floor(MOST_ERRORS * 32 * n + 1e-9)
    done = []
    for j in range(int(n.max()) if len(n) else 0):
        wrong[at] += np.bitwise_count(q.flat[x[at] + j] ^ r.flat[y[at] + j])
        end = n[at] == j + 1
        if j % 4 == 3 or end.any():
            fine = wrong[at] <= most[at]
            done.append(at[end & fine])
            at = at[~end & fine]
        if not len(at):
            break
    done = np.concatenate(done) if done else np.zeros(0, dtype=np.int64)
    return a[done], b[done], wrong[done] / (32 * n[done]), offset[done]


def _everywhere(i: int, q: Recordings, r: Recordings) -> tuple[np.ndarray, ...]:
    """One query against all of r at every offset."""
    found = []
    for length in np.unique(r.size):
        of = np.flatnonzero(r.size == length)
        wrong, offset = _best(q.codes[i], np.ascontiguousarray(r.flat[r.start[of][None, :] + np.arange(length)[:, None]]))
        good = wrong <= MOST_ERRORS
        found.append((np.full(good.sum(), i), of[good], wrong[good], offset[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of rows: the least share of bits that differ from q at any offset, then the smallest offset; 2 if above MOST_ERRORS.

    Half of an overlap is counted first; columns that are over the limit by then are left out, as errors only add up.
    """
    least, best = np.full(rows.shape[1], 2.0), np.zeros(rows.shape[1], dtype=np.int64)
    for offset in range(LEAST_OVERLAP - len(q), len(rows) - LEAST_OVERLAP + 1):
        low = max(0, -offset)
        n = min(len(q) - low, len(rows) - low - offset)
        if n < LEAST_OVERLAP:
            continue
        x, y, half = q[low : low + n, None], rows[low + offset : low + offset + n], n // 2
        wrong = np.bitwise_count(x[:half] ^ y[:half]).sum(axis=0, dtype=np.uint32)
        left = np.flatnonzero(wrong / (32 * n) <= MOST_ERRORS)
        if not len(left):
            continue
        share = (wrong[left] + np.bitwise_count(x[half:] ^ y[half:, left]).sum(axis=0, dtype=np.uint32)) / (32 * n)
        better = (share <= MOST_ERRORS) & (share < least[left])
        least[left[better]], best[left[better]] = share[better], offset
    return least, best


def melody(embeddings: DataFrame, rate: int = 2000, note: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, pcm): each vector played as a row of notes, one for each number; the higher the number, the higher the note.

    The test tables have no recordings; this makes recordings whose likeness follows that of the vectors. Null
    vectors are silent recordings of no length, null numbers are zero; repeated rows and null ids stay, an empty
    table gives an empty result, other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(embeddings.sparkSession)
    kind = embeddings.schema[id_col].dataType.simpleString()
    time = np.arange(note) / rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.nan_to_num(np.array([0.0 if e is None else e for e in v or []], dtype=float), posinf=1.0, neginf=-1.0)
                hz = 110.0 * 2.0 ** (np.clip(np.round((x * np.sqrt(max(len(x), 1)) + 3) * 6), 0, 36) / 12)
                out.append((np.sin(2 * np.pi * hz[:, None] * time) * 12000).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "pcm"])

    return embeddings.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {kind}, pcm binary")
