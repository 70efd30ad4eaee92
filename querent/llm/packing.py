"""Packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Documents that fit a sequence, and the pieces of others, are placed whole by the dot-product heuristic for vector
bin packing: it goes to the open sequence whose remaining room, as a vector of shares of the limits, has the
largest dot product with its own demand. Only then are pieces cut, and only to fill what would be padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from querent.llm.common import arrow_batches
from querent.llm.tokenizing import CACHE_PIECES

#: Documents and tokens that a task holds before it packs them.
HELD_DOCS, HELD_TOKENS = 4096, 2_000_000
#: Open sequences among which a piece is placed; of more, the fullest is set aside to be filled up later.
OPEN = 64
#: Sequences that the limits keep from being full wait for more documents, up to so many; others are divided.
MOST_LEFT = 32
#: Sequence ids count up from the number of the task times this.
IDS_PER_TASK = 1 << 36


@dataclass(frozen=True)
class Limits:
    """tokens must be a power of two; loss is the most loss-bearing tokens and segments the most pieces of a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


Piece = tuple[int, int, int]  # document, first token, end


class Packer:
    """Takes documents as (number, tokens, first loss-bearing token) and gives sequences as lists of pieces."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.loss_from: dict[int, int] = {}
        self.rest: list[Piece] = []

    def loss(self, piece: Piece) -> int:
        return max(0, piece[2] - max(piece[1], self.loss_from[piece[0]]))

    def _demand(self, piece: Piece) -> tuple[int, int, int]:
        return piece[2] - piece[1], 1, self.loss(piece)

    def _chunks(self, doc: int, tokens: int) -> tuple[list[Piece], list[Piece]]:
        """Pieces to be placed, and pieces without loss to fill up with: the document itself if it fits a sequence, else
        its answer in pieces of as many tokens as may bear loss, and its prompt."""
        first, most = min(self.loss_from[doc], tokens), self.limits.loss
        if tokens <= self.limits.tokens and tokens - first <= most:
            return [(doc, 0, tokens)], []
        return [(doc, at, min(tokens, at + most)) for at in range(first, tokens, most)], [(doc, 0, first)] if first else []

    def pack(self, docs: list[tuple[int, int, int]]) -> list[list[Piece]]:
        """Full sequences. What can't fill one, of at most MOST_LEFT sequences, waits for the next call."""
        out: list[list[Piece]] = []
        items, self.rest = self.rest, []
        free: list[Piece] = []
        for doc, tokens, first in docs:
            self.loss_from[doc] = first
            pieces, prompts = self._chunks(doc, tokens)
            free += prompts
            for piece in pieces:
                if piece[2] - piece[1] == self.limits.tokens:
                    out.append([piece])
                else:
                    items.append(piece)
        items.sort(key=lambda p: (p[1] - p[2], p[0], p[1]))
        bins: list[list[Piece]] = []
        aside: list[list[Piece]] = []
        room = np.zeros((OPEN, 3))  # as shares of the limits
        near = 0.5 / self.scale.max()
        for piece in items:
            need = np.array(self._demand(piece)) / self.scale
            n = len(bins)
            value = np.where((room[:n] >= need - near).all(axis=1), room[:n] @ need, -1.0)
            at = int(value.argmax()) if n else -1
            if at < 0 or value[at] < 0:
                if n == OPEN:
                    at = int(room[:, 0].argmin())
                    aside.append(bins[at])
                    bins[at] = []
                else:
                    at = n
                    bins.append([])
                room[at] = 1.0
            bins[at].append(piece)
            room[at] -= need
        return out + self._fill(bins + aside, free)

    def _fill(self, bins: list[list[Piece]], free: list[Piece]) -> list[list[Piece]]:
        """Full sequences: the fuller ones are filled up, with tokens of the emptiest that bear loss as far as the limits
        go, then with tokens that bear none."""
        size = lambda b: sum(p[2] - p[1] for p in b)
        closed, partly = [], []
        for b in bins:
            (closed if size(b) == self.limits.tokens else partly).append(b)
        partly.sort(key=lambda b: (-size(b), b[0]))
        left = deque(partly)
        lossy: list[Piece] = []
        stuck: list[list[Piece]] = []
        while left or lossy or free:
            b = left.popleft() if left else []
            room = (self.scale - np.sum([self._demand(p) for p in b], axis=0)).astype(int).tolist() if b else [self.limits.tokens, self.limits.segments, self.limits.loss]
            while room[0] and room[1]:
                source = lossy if lossy and room[2] else free
                if not source:
                    if not left:
                        break
                    for doc, at, end in left.pop():
                        first = self.loss_from[doc]
                        if at < first:
                            free.append((doc, at, min(end, first)))
                        if end > first:
                            lossy.append((doc, max(at, first), end))
                    continue
                doc, at, end = source.pop()
                cut = min(end, at + room[0], at + room[2] if source is lossy else end)
                b.append((doc, at, cut))
                room = [room[0] - cut + at, room[1] - 1, room[2] - (cut - at if source is lossy else 0)]
                if cut < end:
                    source.append((doc, cut, end))
            (stuck if room[0] else closed).append(b)
        for b in stuck[MOST_LEFT:]:
            closed += self.split(b)
        self.rest = [p for b in stuck[:MOST_LEFT] for p in b]
        return closed

    def split(self, pieces: list[Piece]) -> list[list[Piece]]:
        """Sequences of falling powers of two, which need no padding, with the pieces' tokens in order."""
        left = list(reversed(pieces))
        total = sum(p[2] - p[1] for p in pieces)
        out = []
        for power in reversed(range(total.bit_length())):
            if not total >> power & 1:
                continue
            room, now = 1 << power, []
            while room:
                doc, at, end = left.pop()
                cut = min(end, at + room)
                now.append((doc, at, cut))
                room -= cut - at
                if cut < end:
                    left.append((doc, cut, end))
            out.append(now)
        return out

    def close(self) -> list[list[Piece]]:
        """What is left, in sequences within the limits as long as powers of two."""
        out: list[list[Piece]] = []
        b: list[Piece] = []
        room = self.scale.astype(int).tolist()
        for doc, at, end in self.rest:
            while at < end:
                first = self.loss_from[doc]
                cut = min(end, at + room[0], max(at, first) + room[2])
                if cut <= at or not room[1]:
                    out += self.split(b)
                    b, room = [], self.scale.astype(int).tolist()
                    continue
                b.append((doc, at, cut))
                room = [x - y for x, y in zip(room, self._demand(b[-1]))]
                at = cut
        self.rest = []
        return out + (self.split(b) if b else [])


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), leading_space: bool = True,
    id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None, prompt_share: float = 0.0,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Each document is its token ids (vocabulary: a file of the tokenizers library) and end_id. Its first
    prompt_tokens_col tokens bear no loss (null or negative: all bear loss); without such a column the first
    prompt_share of each document's tokens, rounded down, is its prompt. Each id lies in
    exactly one piece; a sequence keeps the limits and is full, or else as long as a power of two.

    A task packs the documents of its partition in the order they come, a bounded number at a time, and
    holds at most MOST_LEFT sequences that aren't full, so no rows are shuffled and memory is bounded. Sequence ids
    hold the task's number: they are repeatable for docs read from files. Null text counts as empty (its
    end id alone), repeated rows are packed like others, an empty table gives no rows, other columns aren't
    read. cache_pieces bounds a worker's memory for pieces of text; fewer cost time, not results.
    """
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from querent.llm.tokenizing import encoder

        coder = encoder(vocabulary, leading_space, cache_pieces)
        encode = coder.encode_batch
        packer = Packer(limits)
        next_id = TaskContext.get().partitionId() * IDS_PER_TASK
        held: dict[int, tuple[object, bytes]] = {}
        waiting: list[tuple[int, int, int]] = []
        tokens = number = 0

        def rows(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            out = [[] for _ in names]
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    doc, at, to = piece
                    own, ids = held[doc]
                    for column, value in zip(out, (own, at, to - at, crc32(memoryview(ids)[4 * at : 4 * to]), len(ids) // 4, next_id, offset, packer.loss(piece))):
                        column.append(value)
                    offset += to - at
                next_id += 1
            keep = {p[0] for p in packer.rest}
            for doc in [d for d in held if d not in keep]:
                del held[doc], packer.loss_from[doc]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], key_type), *(pa.array(c, pa.int64()) for c in out[1:])], names=names)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            given = b.column(2).to_pylist() if b.num_columns > 2 else None
            for i, (own, ids) in enumerate(zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()))):
                ids += end
                first = given[i] if given else int(prompt_share * (len(ids) // 4))
                held[number] = (own, ids)
                waiting.append((number, len(ids) // 4, max(0, first or 0)))
                number += 1
                tokens += len(ids) // 4
                if len(waiting) >= HELD_DOCS or tokens >= HELD_TOKENS:
                    yield from rows(packer.pack(waiting))
                    waiting, tokens = [], 0
        if waiting:
            yield from rows(packer.pack(waiting))
        yield from rows(packer.close())
        coder.forget()

    columns = [id_col, text_col, *([prompt_tokens_col] if prompt_tokens_col else [])]
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names[1:]))
