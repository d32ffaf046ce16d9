"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of its Lempel-Ziv dictionary: each phrase is
the shortest continuation not seen before. The set of phrases is hashed, and the
minima of ``SIZE`` hash functions are the fingerprint, 16 bits each, as hex. The
share of equal minima estimates the Jaccard similarity of two phrase sets, which
is high where one text helps to compress the other.

``neighbours`` also follows the ids in ascending order. Rows are dealt by id into
ranges whose bounds are quantiles of the id; a range also gets the first row of
the next one, so every row meets its successor in one pass over a sorted stream,
whatever the size of a range.

Defined results: a null text is an empty one; empty texts have the fingerprint of
all ones, equal to each other (likeness 1) and unlike all others (0); null ids
come first; rows of one id are ordered by text; the only row of a table is its
own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import text_or_empty

SIZE = 128
ROWS_PER_RANGE = 4_000
MAX_RANGES = 4_096

_SEEDS = np.random.default_rng(20).integers(1, 2**63, (2, SIZE), dtype=np.uint64)
_MULTIPLY, _ADD = _SEEDS[0] | np.uint64(1), _SEEDS[1]
_EMPTY = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)

SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def parse(text: str, seen: set[str], pending: str = "") -> str:
    """Add the phrases of ``text`` to ``seen``; returns the unfinished phrase.

    A text parsed in parts, each with the pending phrase of the one before, has
    the phrases it has as a whole.
    """
    add = seen.add
    phrase = pending
    for char in text:
        phrase += char
        if phrase not in seen:
            add(phrase)
            phrase = ""
    return phrase


def minima(phrases: set[str], block: int = 4096) -> np.ndarray:
    """Smallest value of each hash function over the phrases."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
    least = _EMPTY
    for at in range(0, len(hashes), block):
        mixed = hashes[at:at + block, None] * _MULTIPLY + _ADD
        least = np.minimum(least, mixed.min(0))
    return least


def compact(least: np.ndarray) -> np.ndarray:
    return (least >> np.uint64(32) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class Prints:
    """Fingerprint of a text and of the text with another tail, parsed once up to the cut."""

    def __init__(self, text: str):
        self.text = text
        self.cut = len(text) - len(text) // 4
        seen: set[str] = set()
        self.pending = parse(text[: self.cut], seen)
        self.head = seen
        self.head_minima = minima(seen)
        self.minima = self._with_tail(text[self.cut:])
        self.compact = compact(self.minima)

    def _with_tail(self, tail: str) -> np.ndarray:
        # phrases of the tail are those missing from the head
        seen = set(self.head)
        parse(tail, seen, self.pending)
        return np.minimum(self.head_minima, minima(seen - self.head))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        tail = following[: len(self.text) - self.cut]
        return self.text[: self.cut] + tail, compact(self._with_tail(tail))


def fingerprint(text: str) -> str:
    seen: set[str] = set()
    parse(text, seen)
    return compact(minima(seen)).tobytes().hex()


def _bounds(rows: DataFrame, ranges: int) -> list[float]:
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    return sorted(set(rows.approxQuantile("doc_id", shares, 1 / (4 * ranges))))


def _in_ranges(docs: DataFrame, per_range: int) -> tuple[DataFrame, int]:
    """Rows with ``part`` and ``last``: each part and, marked, the first row after it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.count()
    bounds = _bounds(rows, min(MAX_RANGES, -(-total // per_range)))
    part = F.coalesce(_place(bounds, F.col("doc_id")), F.lit(0)) if bounds else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = {r["part"]: r["first"] for r in rows.groupBy("part").agg(
        F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).collect()}
    parts = sorted(firsts)
    nulls = bool(parts) and rows.filter(F.col("doc_id").isNull()).limit(1).count() > 0
    before = {parts[k]: parts[k - 1] for k in range(len(parts))}
    spark = docs.sparkSession
    wanted = spark.createDataFrame(
        [(p, None if p == parts[0] and nulls else firsts[p], before[p]) for p in parts],
        "part int, first bigint, before int",
    )
    carried = (
        rows.join(F.broadcast(wanted), "part")
        .filter(F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("before")
        .agg(F.min(F.struct("part", "text", "doc_id")).alias("row"))
        .select("row.doc_id", "row.text", F.col("before").alias("part"), F.lit(True).alias("last"))
    )
    return rows.withColumn("last", F.lit(False)).unionByName(carried), max(parts, default=0) + 1


def _place(bounds: list[float], value: Column, width: int = 64) -> Column:
    """How many bounds lie below ``value``, found in two steps."""
    groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    below = lambda edges: F.size(F.filter(edges, lambda b: b < value))
    literal = lambda edges: F.array(*[F.lit(b) for b in edges])
    coarse = below(literal([g[-1] for g in groups]))
    fine = below(F.get(F.array(*[literal(g) for g in groups]), coarse))
    return coarse * width + F.greatest(fine, F.lit(0))


def neighbours(docs: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near it is to its successor.

    The edited text has its last quarter replaced by as many leading characters
    of the next document, by ascending id; the last document is followed by the
    first.
    """
    rows, parts = _in_ranges(docs, per_range)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc_id, text, part, last in zip(*(c.to_pylist() for c in batch.columns)):
                prints = Prints(text)
                if held is not None and held[2] == part:
                    out.append(_row(held[0], held[1], prints))
                held = None if last else (doc_id, prints, part)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    sorted_rows = (
        rows.select("doc_id", "text", "part", "last")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "text")
    )
    return sorted_rows.mapInArrow(run, SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
])


def _row(doc_id, prints: Prints, following: Prints) -> dict:
    text, edited = prints.edited(following.text)
    return {
        "doc_id": doc_id,
        "n_chars": len(prints.text),
        "edited_sha256": hashlib.sha256(text.encode()).hexdigest(),
        "fingerprint": prints.compact.tobytes().hex(),
        "edited_fingerprint": edited.tobytes().hex(),
        "near_edited": likeness(prints.compact, edited),
        "near_next": likeness(prints.compact, following.compact),
    }
