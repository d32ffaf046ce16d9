"""Token ids in Arrow files of equal-length sequences, with random access and no copies.

All documents form one stream of ids in ascending order of their ids, each with an
end id. The stream is cut into files at ends of documents, and in a file into
sequences of equal length. A file is an Arrow IPC file of two fixed-size-list
columns, ``ids`` and ``mask`` (false where the last sequence is padded); every
record batch but the last has the same number of rows, so the place of a sequence
is known without reading others, and a mapped file gives it without a copy. A
second Arrow file beside it lists the documents: ``doc_id``, their ``start`` in the
file and ``length``.

Rows are dealt by ranges of ids, sorted in their partition, encoded and written by
the task that holds them; a task keeps one record batch and one document. Names
of files are drawn anew by every attempt, and only the rows of committed tasks
reach the manifest, a table written by Spark, so files of lost attempts are never
read.

Defined results: a null or empty text is its end id alone; null ids come first;
rows of one id are ordered by a hash of the text, equal rows by their place in the
table; an empty table gives no files; a document longer than a file's size is still in
one file; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeloom.llm.byte_bpe import encoded, encoder_of
from cladeloom.llm.common import text_or_empty
from cladeloom.session import materialize, metric, scratch_path, sized_partitions

LENGTH = 2048
END_ID = 2
ROWS = 256
FILE_TOKENS = 1 << 26
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
INDEX_ROWS = 1 << 14

MANIFEST = "part int, number int, path string, documents bigint, sequences bigint, tokens bigint"


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows it."""
    id_type = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(id_type, length), nullable=False),
                      pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)])


def index_path(path: str) -> str:
    return path.removesuffix(".arrow") + ".docs.arrow"


class FileWriter:
    """One file of sequences and its list of documents."""

    def __init__(self, path: str, schema: pa.Schema, rows: int = ROWS):
        self.path, self.schema, self.rows = path, schema, rows
        self.length = schema.field("ids").type.list_size
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.buffer = np.zeros(rows * self.length, self.dtype)
        self.held = self.tokens = self.documents = self.sequences = 0
        self.listed: list[tuple] = []
        store, place = fs.FileSystem.from_uri(path)
        self.out = [store.open_output_stream(p) for p in (place, index_path(place))]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (schema, INDEX))]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.listed.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.documents += 1
        while len(ids):
            part = ids[: len(self.buffer) - self.held]
            self.buffer[self.held:self.held + len(part)] = part
            self.held += len(part)
            ids = ids[len(part):]
            if self.held == len(self.buffer):
                self._flush()
        if len(self.listed) >= INDEX_ROWS:
            self._flush_index()

    def _flush(self) -> None:
        rows = -(-self.held // self.length)
        self.buffer[self.held:] = 0
        size = rows * self.length
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self.buffer[:size]), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < self.held), self.length)
        self.writers[0].write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))
        self.sequences += rows
        self.held = 0

    def _flush_index(self) -> None:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.listed), INDEX)]
        self.writers[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))
        self.listed = []

    def close(self) -> None:
        if self.held:
            self._flush()
        if self.listed:
            self._flush_index()
        for each in (*self.writers, *self.out):
            each.close()


class TokenFile:
    """Random access to the sequences and documents of one written file."""

    def __init__(self, path: str):
        self.sequences, self.index = (self._open(p) for p in (path, index_path(path)))
        self.batches = self.sequences.num_record_batches
        self.length = self.sequences.schema.field("ids").type.list_size
        self.rows = self.sequences.get_batch(0).num_rows if self.batches else 0

    @staticmethod
    def _open(path: str) -> pa.ipc.RecordBatchFileReader:
        store, place = fs.FileSystem.from_uri(path)
        local = isinstance(store, fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(place) if local else store.open_input_file(place))

    def __len__(self) -> int:
        if not self.batches:
            return 0
        return (self.batches - 1) * self.rows + self.sequences.get_batch(self.batches - 1).num_rows

    def flat(self, batch: int) -> np.ndarray:
        """All ids of one record batch, a view of the file where it is mapped."""
        return self.sequences.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``, neither of them copied."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, row = self.sequences.get_batch(k // self.rows), k % self.rows
        ids, mask = (c.slice(row, 1).flatten() for c in batch.columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document, in order; one batch is held at a time."""
        size, at, flat = self.rows * self.length, -1, None
        for b in range(self.index.num_record_batches):
            for row in zip(*(c.to_pylist() for c in self.index.get_batch(b).columns)):
                doc_id, start, left = row
                parts, place = [], start
                while left:
                    if place // size != at:
                        at = place // size
                        flat = self.flat(at)
                    part = flat[place % size:][:left]
                    parts.append(part)
                    place, left = place + len(part), left - len(part)
                yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
    rows: int = ROWS,
) -> DataFrame:
    """Write all documents below ``folder`` (a URI every executor reaches); returns the manifest.

    The manifest has a row per file: (part, number, path, documents, sequences,
    tokens, before), ``before`` being the ids in all files ahead of it.
    ``tokenizer_path`` names a tokenizer file present on every machine.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token_files")
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = sequence_schema(length, encoder_of(tokenizer_path).size)
        part, number, writer = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc_id, ids in encoded(batch, tokenizer_path, end_id):
                if writer is None:
                    path = f"{folder.rstrip('/')}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow"
                    writer = FileWriter(path, schema, rows)
                writer.add(doc_id, ids)
                if writer.tokens >= file_tokens:
                    yield closed(writer, part, number)
                    writer, number = None, number + 1
        if writer is not None:
            yield closed(writer, part, number)

    def closed(writer: FileWriter, part: int, number: int) -> pa.RecordBatch:
        writer.close()
        row = dict(part=part, number=number, path=writer.path, documents=writer.documents,
                   sequences=writer.sequences, tokens=writer.tokens)
        return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

    keyed = docs.select(
        F.col("doc_id").cast("bigint"), text_or_empty().alias("text"),
        F.xxhash64(text_or_empty()).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    dealt = keyed.repartitionByRange(sized_partitions(docs), *order).sortWithinPartitions(*order)
    written = materialize(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "token_manifest")
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(
        written.withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))), "token_manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()),
                       ("documents", pa.int64()), ("sequences", pa.int64()), ("tokens", pa.int64())])


def read_documents(manifest: DataFrame, block: int = 1 << 22) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit numbers, the end id included. A task reads one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for doc_id, start, ids in TokenFile(path).documents():
                    held.append((doc_id, before + start, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size >= block:
                        yield _documents(held)
                        held, size = [], 0
                if held:
                    yield _documents(held)

    files = manifest.select("path", "before").repartitionByRange(max(1, metric(manifest)), "before")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def read_sequences(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sequence, ids, mask) of the sequences numbered ``sequence`` in ``wanted``, over all files in order.

    Numbers beyond the last sequence and null ones give no row; repeated ones give one.
    """
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("sequences").over(ahead), F.lit(0)).alias("first")
    files = manifest.select("path", "sequences", first)
    bounds = [(r["first"], r["path"]) for r in files.orderBy("first").toLocalIterator()]
    total = manifest.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(bounds)  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, at, opened = np.array([b[0] for b in shared.value], np.int64), -1, None
        for batch in batches:
            rows = []
            for number in batch.column(0).to_pylist():
                place = int(np.searchsorted(starts, number, side="right")) - 1
                if place != at:
                    at, opened = place, TokenFile(shared.value[place][1])
                ids, mask = opened.sequence(number - int(starts[place]))
                rows.append((number, ids.astype(np.int64), mask))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[2].to_pylist() for r in rows], pa.list_(pa.bool_()))], names=["sequence", "ids", "mask"])

    numbers = wanted.select(F.col("sequence").cast("bigint")).filter(F.col("sequence").between(0, total - 1)).distinct()
    ordered = numbers.repartitionByRange("sequence").sortWithinPartitions("sequence")
    return ordered.mapInArrow(run, "sequence bigint, ids array<bigint>, mask array<boolean>")
