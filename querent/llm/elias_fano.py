"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of a run of documents end to end, and where each document ends as an Elias-Fano
sequence: the low bits of each end in an array, the high bits as unary gaps in a bit vector with a directory
of counts, so that the i-th end is found by a select on the bit vector. This takes about 2 + log2(ids per
document) bits a document instead of 64.

The documents' own ids are a second Elias-Fano sequence, of what they exceed the file's first one by.

Layout, little-endian: magic, bytes of an id (1), documents (8), those without an id, which come first (8), ids (8),
the smallest document id (8); twice (ends, document ids, 0 for those without) low bits (1), bytes of the high bits (8), directory (4 for each 512 bits), high bits, low
bits; ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querent.llm.common import arrow_batches, materialize, new_path

#: Fixed values of the file format.
MAGIC = b"EFIDS3\0\0"
HEADER = "<8sBQQQq"
PART = "<BQ"
BLOCK = 512

#: A file is closed when it has this many ids or documents, and a task's next one begins.
FILE_IDS, FILE_DOCS = 1_000_000, 50_000
#: Nor do document ids of a file lie further apart.
FILE_SPAN = 1 << 62
#: Characters of the text by which rows of one id are in order.
TIED = 64


class EliasFano:
    """A rising sequence of n numbers up to `most`."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, directory: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.directory, self.low = n, low_bits, high, directory, low

    @classmethod
    def build(cls, values: np.ndarray, most: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(most // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        bits = np.zeros(-(-(n + (most >> low_bits) + 1) // BLOCK) * BLOCK, dtype=np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        directory = np.concatenate(([0], bits.reshape(-1, BLOCK).sum(axis=1).cumsum()))[:-1].astype("<u4")
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), directory, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"))

    def get(self, index: np.ndarray) -> np.ndarray:
        """The numbers at the given places, by select on the high bits."""
        out = np.empty(len(index), dtype=np.int64)
        blocks = self.high.reshape(-1, BLOCK // 8)
        for at in range(0, len(index), 2048):
            i = index[at : at + 2048]
            block = np.searchsorted(self.directory, i, side="right") - 1
            inside = np.unpackbits(blocks[block], axis=1, bitorder="little").cumsum(axis=1, dtype=np.int32)
            place = (inside > (i - self.directory[block])[:, None]).argmax(axis=1)
            high = block.astype(np.int64) * BLOCK + place - i
            bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
            low = ((self.low[bit >> 3] >> (bit & 7)).astype(np.int64) & 1) << np.arange(self.low_bits)
            out[at : at + 2048] = (high << self.low_bits) | low.sum(axis=1)
        return out


    def all(self) -> np.ndarray:
        """All numbers, in one pass over the bits."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        lows = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((place - np.arange(self.n)) << self.low_bits) | lows @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def tobytes(self) -> bytes:
        return b"".join((struct.pack(PART, self.low_bits, len(self.high)), self.directory.tobytes(), self.high.tobytes(), self.low.tobytes()))

    @classmethod
    def read(cls, raw: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        """The sequence of n numbers that begins at a place, and the place after it."""
        low_bits, high = struct.unpack_from(PART, raw, at)
        at += struct.calcsize(PART)
        parts = []
        for kind, count in (("<u4", high * 8 // BLOCK), ("u1", high), ("u1", -(-n * low_bits // 8))):
            parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        return cls(n, low_bits, parts[1], parts[0], parts[2]), at


def file_bytes(doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """A file of documents with rising ids, those without one first, whose token ids are given as little-endian unsigned
    32-bit numbers.

    Fails if a token id doesn't fit id_bytes bytes, or if a file's document ids lie 2^62 apart or more.
    """
    ends = np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    wide = np.frombuffer(b"".join(ids), dtype="<u4")
    if len(wide) and int(wide.max()) >> (8 * id_bytes):
        raise ValueError(f"token id {int(wide.max())} doesn't fit {id_bytes} bytes")
    nameless = sum(d is None for d in doc_ids)
    named = doc_ids[nameless:]
    least = named[0] if named else 0
    if named and named[-1] - least >= 1 << 62:
        raise ValueError("the document ids of a file lie too far apart")
    own = np.array([0] * nameless + [d - least for d in named], dtype=np.int64)
    head = struct.pack(HEADER, MAGIC, id_bytes, len(ids), nameless, total, least)
    return b"".join((head, EliasFano.build(ends, total).tobytes(), EliasFano.build(own, int(own[-1]) if len(own) else 0).tobytes(), wide.astype(f"<u{id_bytes}").tobytes()))


class File:
    """Reads a file: doc_ids(), of which the first `nameless` say nothing, ends(), and ids(i) of the i-th document."""

    def __init__(self, raw: bytes):
        magic, self.id_bytes, self.n, self.nameless, self.total, self.least = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.boundaries, at = EliasFano.read(raw, struct.calcsize(HEADER), self.n)
        self.documents, at = EliasFano.read(raw, at, self.n)
        self.payload = np.frombuffer(raw, dtype=f"<u{self.id_bytes}", count=self.total, offset=at)

    def doc_ids(self) -> np.ndarray:
        return self.documents.all() + self.least

    def ends(self) -> np.ndarray:
        return self.boundaries.all()

    def ids(self, i: int) -> np.ndarray:
        first = int(self.boundaries.get(np.array([i - 1]))[0]) if i else 0
        return self.payload[first : int(self.boundaries.get(np.array([i]))[0])]


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_bytes: int = 2, leading_space: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode docs and write token-id files, in rising order of the integer id, below path. id_bytes: 2 or 4, for
    vocabularies of up to 2^16 or 2^32 ids; an id beyond fails.

    docs are dealt to tasks by ranges and sorted there, so files follow each other in order over all tasks. Rows with one
    id, however many, come in the order of their texts' first TIED characters, then of a hash of the texts, and are
    ranges like others. Each file is a row (part, number, docs,
    ids, file) of a Parquet table, since Spark's writers reach every store. Null text counts as empty,
    null ids come first and are read back as null, an empty table gives no file, other columns aren't read.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["part", "number", "docs", "ids", "file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from querent.llm.tokenizing import encoder

        coder = encoder(vocabulary, leading_space)
        encode = coder.encode_batch
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        first: int | None = None
        total = 0

        def row() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, number, len(ids), total, file_bytes(doc_ids, ids, id_bytes)), kinds)], names=names)

        for b in batches:
            for doc_id, own in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                far = first is not None and doc_id is not None and doc_id - first >= FILE_SPAN
                if ids and (total >= FILE_IDS or len(ids) >= FILE_DOCS or far):
                    yield row()
                    doc_ids, ids, total, number, first = [], [], 0, number + 1, None
                first = doc_id if first is None else first
                ids.append(own + end)
                doc_ids.append(doc_id)
                total += len(ids[-1]) // 4
        if ids:
            yield row()
        coder.forget()

    by = ["id", "begins", "tie"]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.left(text_col, F.lit(TIED)).alias("begins"), F.xxhash64(text_col).alias("tie"))
    ordered = own.repartitionByRange(*by).sortWithinPartitions(*by)
    files = ordered.select("id", "text").mapInArrow(run, "part long, number long, docs long, ids long, file binary")
    files.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every document in the files below path; null ids come back as null,
    repeated ones as often as they were written, and no files give no rows.

    start counts the ids of all documents before it, over all files. Only two numbers a file are summed up
    for that, and of those only the tasks' totals meet in one place.
    """
    import pyarrow as pa

    arrow_batches(spark)
    files = spark.read.schema("part long, number long, docs long, ids long, file binary").parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(W.orderBy("part")) - F.col("in_part")).alias("before"))
    inside = files.select("part", "number", (F.sum("ids").over(W.partitionBy("part").orderBy("number")) - F.col("ids")).alias("inside"))
    starts = materialize(inside.join(before, "part").select("part", "number", (F.col("before") + F.col("inside")).alias("first")), "starts")
    placed = files.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["part", "number"])
    names = [id_col, "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1)):
                f = File(raw.as_buffer())
                ends = f.ends()
                begins = np.concatenate(([0], ends[:-1])) if f.n else ends
                wide = f.payload.astype("<u4").tobytes()
                view = memoryview(wide)
                sums = [crc32(view[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                doc_ids = f.doc_ids()
                own = pa.array(doc_ids, pa.int64(), mask=np.arange(f.n) < f.nameless)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (begins + first, ends - begins, sums))], names=names)

    return placed.select("first", "file").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int, **options) -> DataFrame:
    """write() into the shared folder, then read()."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, vocabulary, end_id, **options)
    return read(docs.sparkSession, path)
