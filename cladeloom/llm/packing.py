"""Packing token sequences by minimum bin slack.

Documents are tokenized in Arrow batches and packed in the same task, so nothing
is shuffled. A document is its token ids and an end id. Whole windows of a long
document fill sequences of their own; the remainders of a buffer of documents
are packed one sequence at a time: the longest remainder is fixed, and a subset
sum over the multiset of remaining lengths, kept as the bits of one integer,
finds the lengths that come closest to the capacity left. The counts of each
length are read back from the saved bitsets. What slack still remains is filled
with the head of the longest remaining piece, so every sequence is full; less
than one capacity is carried to the next buffer, and at the end of a task it is
laid out in sequences whose sizes are powers of two.

Defined results: a null or empty text is one sequence piece with the end id
alone; a null id stays null; repeated rows are packed each for itself; an empty
table gives no pieces. Columns besides ``doc_id`` and ``text`` are ignored. A
task keeps at most ``BUFFER`` tokens besides the document at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.byte_bpe import CACHE, encoded
from cladeloom.llm.common import text_or_empty

CAPACITY = 2048
END_ID = 1
BUFFER = 1 << 20
_PART_BITS = 40

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def fill(counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of a sub-multiset whose sum comes closest to ``capacity``."""
    reach, history = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left = min(counts[length], capacity // length)
        step = 1
        while left:
            step = min(step, left)
            history.append((length, step, reach))
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, step, before in reversed(history):
        if not before >> at & 1:
            chosen.append((length, step))
            at -= length * step
    return chosen


class Piece(NamedTuple):
    """Ids of a document from ``start`` on; a waiting piece holds no ids but its own."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    total: int

    def split(self, size: int) -> tuple[Piece, Piece | None]:
        if size >= len(self.ids):
            return self, None
        return self._replace(ids=self.ids[:size]), self._replace(start=self.start + size, ids=self.ids[size:].copy())


class Packer:
    """Turns documents into pieces, each a place in one sequence."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, buffer: int = BUFFER):
        self.next_sequence = first_sequence
        self.capacity = capacity
        self.buffer = buffer
        self.counts = [0] * (capacity + 1)
        self.waiting: list[list[Piece]] = [[] for _ in range(capacity + 1)]
        self.total = 0
        self.longest = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([Piece(doc_id, start, ids[start:start + self.capacity], len(ids))])
        if whole < len(ids):
            self._wait(Piece(doc_id, whole, ids[whole:].copy(), len(ids)))
        if self.total >= self.buffer:
            self._pack()

    def finish(self) -> None:
        self._pack()
        rest = [p for length in range(self.longest, 0, -1) for p in self.waiting[length]]
        size = 1 << max(0, self.total.bit_length() - 1)
        while self.total:
            if size <= self.total:
                self.total -= size
                self._emit(self._cut(rest, size))
            size >>= 1

    def _cut(self, rest: list[Piece], size: int) -> list[Piece]:
        taken = []
        while size:
            head, tail = rest.pop(0).split(size)
            taken.append(head)
            if tail is not None:
                rest.insert(0, tail)
            size -= len(head.ids)
        return taken

    def _wait(self, piece: Piece) -> None:
        length = len(piece.ids)
        self.counts[length] += 1
        self.waiting[length].append(piece)
        self.total += length
        self.longest = max(self.longest, length)

    def _take(self, length: int) -> Piece:
        self.counts[length] -= 1
        self.total -= length
        return self.waiting[length].pop()

    def _take_longest(self) -> Piece:
        while not self.counts[self.longest]:
            self.longest -= 1
        return self._take(self.longest)

    def _pack(self) -> None:
        while self.total >= self.capacity:
            chosen = [self._take_longest()]
            room = self.capacity - len(chosen[0].ids)
            for length, copies in fill(self.counts, room):
                chosen.extend(self._take(length) for _ in range(copies))
                room -= length * copies
            if room:
                head, tail = self._take_longest().split(room)
                chosen.append(head)
                self._wait(tail)
            self._emit(chosen)

    def _emit(self, chosen: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in chosen:
            self.pieces.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def drain(self) -> pa.RecordBatch:
        rows, self.pieces = self.pieces, []
        columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
        )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit numbers. ``tokenizer_path`` names a
    tokenizer file present on every machine. ``cache`` bounds what a worker process
    keeps of the pre-tokens it has met, and changes only memory and time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << _PART_BITS)
        for batch in batches:
            for doc_id, ids in encoded(batch, tokenizer_path, end_id, cache):
                packer.add(doc_id, ids)
                if len(packer.pieces) >= 500:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    rows = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset",
    )
