"""Phrase collocations from weighted acyclic automata.

Shards count their n-grams into automata, one per language and range of first words,
built from sorted n-grams. The automata of a range meet in one task, which sums their
weights, in two steps: of 64 shards at a time, then of all. Ranges are of the hash of
the first word, which makes them even; those of a word with more than ``RANGE``
occurrences are divided by the second word. Three
passes keep the tables small without losing a count: only words that occur often
enough can be in a phrase that does, and only pairs of words that do in a longer
one. Which words and pairs do is sent to the shards as a bitmap of hashes of
bounded size; a collision there costs work, not correctness, as the counts go by
the words themselves.

A candidate needs the counts of its parts. First parts lie on its own path. For the
rest, each first word sends an automaton of the wanted phrases to the
first word of the rest, where it is composed with the counts and sent back. The
phrases of the second word that never occur without the first come out of the
same composition.

Defined results: a null text is empty; a null language is ``und``; repeated
rows count repeatedly; ids do not matter; languages without candidates have no
rows; an empty table gives none; columns besides ``lang`` and ``text`` are ignored.
Memory of a task: ``CHUNK`` words and their distinct ones, or the phrases of one range.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.automata import Automaton, Builder, composed, pruned, union
from cladeloom.llm.common import text_or_empty
from cladeloom.session import materialize, metric

LEAST = 100
LONGEST = 5
TOP = 2000
CHUNK = 1 << 22
SHARDS = 64
RANGE = 1 << 21
LEAST_RANGES, MOST_RANGES = 128, 1 << 20
SPLIT = 16
MAX_BITS = 28
UNKNOWN = "und"
MAX_BROADCAST_ROWS = 200_000

_STOP = b"."
_PIECE_ENDS = bytes.maketrans(b",;:!?\n\v\f\r", _STOP * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z), with a full stop, which no word holds, at every end of a piece."""
    return text.encode().lower().translate(_PIECE_ENDS).replace(_STOP, b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    """As ``F.xxhash64("lang", "word")``, unsigned."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mixed = (one ^ (two * _MIX)) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text"))


def bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """A bit per hash modulo a power of two, about sixteen bits a hash and at most 2**MAX_BITS in all."""
    bits = min(MAX_BITS, max(16, (16 * max(1, count) - 1).bit_length()))
    found = np.zeros(1 << (bits - 6), np.uint64)
    place = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).alias("place")
    rows = hashes.select(place, F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    found[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return found


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word = bits[((hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)]
    return (word >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, total) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[lang].update(words_of(text.as_py()))
            if sum(map(len, held.values())) > CHUNK // 8:
                yield from told(held)
                held.clear()
        yield from told(held)

    def told(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_STOP, None)
            if counts:
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(counts)), words, pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "word", "total"])

    shards = _rows(docs).mapInArrow(run, "lang string, word string, total bigint")
    return shards.groupBy("lang", "word").agg(F.sum("total").alias("total"))


Windows = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Ranges:
    """How n-grams are dealt: ``count`` ranges of first words, and parts of those of frequent words."""

    count: int
    parts: dict[tuple[str, bytes], int]

    @staticmethod
    def of(frequent: DataFrame, total: int) -> Ranges:
        """About ``RANGE`` occurrences of first words in a range; no more frequent words than that can be."""
        each = max(RANGE, -(-total // MOST_RANGES))
        hot = frequent.filter(F.col("total") > each).collect()
        return Ranges(max(LEAST_RANGES, -(-total // each)),
                      {(r["lang"], r["word"].encode()): -(-r["total"] // each) for r in hot})


def _shards(docs: DataFrame, words: np.ndarray, ranges: Ranges, first: int,
            windows: Callable[[np.ndarray, np.ndarray, np.ndarray], Windows]) -> DataFrame:
    """(lang, range, shard, data): the n-grams of a shard in a range, as automata.

    ``windows(ids, fit, hashes)`` tells the places of n-grams and their numbers of
    words; the prefixes of ``first`` words or more are counted. ``fit`` tells which ids
    are words that ``words`` has.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((words, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() // SHARDS
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_of(text.as_py())
                if lang not in held:
                    known = defaultdict()
                    known.default_factory = known.__len__
                    known[_STOP]  # the first id
                    held[lang] = known, []
                known, parts = held[lang]
                parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                size += len(found) + 1
                if size > CHUNK:
                    yield from told(held, shard)
                    held, size = {}, 0
        yield from told(held, shard)

    def told(held: dict, shard: int) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            known, parts = held.pop(lang)
            for place, data in counted(lang, list(known), np.concatenate(parts)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([place], pa.int64()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())],
                    names=["lang", "range", "shard", "data"])

    def counted(lang: str, names: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        bits, dealt = shared.value
        hashes = np.fromiter((word_hash(lang, w) for w in names), np.uint64, len(names))
        fit = has(bits, hashes)
        fit[0] = False
        ascending = sorted(np.flatnonzero(fit).tolist(), key=names.__getitem__)
        words = [names[k] for k in ascending]
        rank = np.full(len(names), -1, np.int32)
        rank[ascending] = np.arange(len(words), dtype=np.int32)
        at, length = windows(ids, fit, hashes)
        if not len(at):
            return
        longest = int(length.max())
        padded = np.append(rank[ids], np.full(longest, -1, np.int32))
        columns = [np.where(length > k, padded[at + k], -1) for k in range(longest)]
        parts = np.fromiter((dealt.parts.get((lang, w), 1) for w in words), np.uint64, len(words))
        ordered = hashes[ascending]
        place = (ordered % np.uint64(dealt.count) << np.uint64(32))[columns[0]] + ordered[columns[1]] % parts[columns[0]]
        columns = [place.astype(np.int64), *columns]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(at))).tolist()
        place, *columns = [c[starts] for c in columns]
        edges = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist()
        for lo, hi in zip(edges, [*edges[1:], len(place)]):
            builder = Builder()
            for row, count in zip(zip(*(c[lo:hi].tolist() for c in columns)), counts[lo:hi]):
                builder.add(tuple([words[k] for k in row if k >= 0]), count, first)
            yield int(place[lo]), builder.finish().pack()

    return _rows(docs).mapInArrow(run, "lang string, range bigint, shard int, data binary")


def _by_key(rows: DataFrame, keys: list[str], columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(key, rows)`` over the rows of each key, as tuples of ``columns``; what it yields are rows of ``schema``."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [part.split() for part in schema.split(", ")]

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out, size = [], 0
        for key, group in groupby(given, key=lambda row: row[:len(keys)]):
            for row in run(key, (row[len(keys):] for row in group)):
                out.append(row)
                size += sum(len(v) for v in row if isinstance(v, bytes))
                if len(out) >= 1000 or size > 1 << 24:
                    yield listed(out)
                    out, size = [], 0
        if out:
            yield listed(out)

    def listed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)],
                                          names=[name for name, _ in fields])

    order = [*keys, *[F.col(c).asc_nulls_first() for c in columns if c != "data"]]
    dealt = rows.repartition(*keys).sortWithinPartitions(*order).select(*keys, *columns)
    return dealt.mapInArrow(batched, schema)


def _summed(rows: Iterator[tuple[bytes]]) -> Automaton:
    """The union of packed automata, of which a bounded number is unpacked at a time."""
    held = []
    for (data,) in rows:
        held.append(Automaton.unpack(data))
        if len(held) == SHARDS:
            held = [union(held)]
    return union(held)


def _frequent(shards: DataFrame, least: int, name: str) -> DataFrame:
    """(lang, head, data, h): over all shards, what follows a first word at least ``least`` times.

    ``h`` has the hashes of the pairs of ``head`` and a second word. The words of a
    divided range come in several rows.
    """

    def some(key: tuple, rows: Iterator[tuple[bytes]]) -> Iterator[tuple]:
        first = next(rows)
        second = next(rows, None)  # most often a shard has one row, which passes as it is
        yield (*key, first[0] if second is None else _summed(chain([first, second], rows)).pack())

    def whole(key: tuple, rows: Iterator[tuple[bytes]]) -> Iterator[tuple]:
        lang = key[0]
        found = pruned(_summed(rows), least)
        for head, state in found.arcs(found.root).items():
            following = found.below(state)
            pairs = [w for w, t in following.arcs(following.root).items() if following.states[t][0] >= least]
            ends = np.fromiter((word_hash(lang, w) for w in pairs), np.uint64, len(pairs))
            both = pair_hash(np.uint64(word_hash(lang, head)), ends)
            yield lang, head.decode(), following.pack(), both.view(np.int64).tolist()

    by_shard = _by_key(shards, ["lang", "range", "shard"], ["data"], some, "lang string, range bigint, shard int, data binary")
    found = _by_key(by_shard, ["lang", "range"], ["data"], whole, "lang string, head string, data binary, h array<bigint>")
    return materialize(found, name, pairs=F.sum(F.size("h")))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Counts of all frequent phrases, and the number of words of each language.

    The first table has (lang, head, data): ``data`` is an automaton of what
    follows the word ``head``, its root having the count of ``head`` itself. The
    second has (lang, n).
    """
    context = docs.sparkSession.sparkContext
    counted = materialize(count_words(docs), "words")
    totals = materialize(counted.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    frequent = materialize(counted.filter(F.col("total") >= least), "frequent_words", occurrences=F.sum("total"))
    words = bitmap(frequent.select(F.xxhash64("lang", "word").alias("h")), metric(frequent))
    ranges = Ranges.of(frequent, metric(frequent, "occurrences") or 0)

    def pairs_at(ids: np.ndarray, fit: np.ndarray, hashes: np.ndarray) -> Windows:
        ok = fit[ids]
        at = np.flatnonzero(ok[:-1] & ok[1:])
        return at, np.full(len(at), 2)

    pairs = _frequent(_shards(docs, words, ranges, 2, pairs_at), least, "pairs")
    shared = context.broadcast(bitmap(pairs.select(F.explode("h").alias("h")), metric(pairs, "pairs") or 0))

    def longer_at(ids: np.ndarray, fit: np.ndarray, hashes: np.ndarray) -> Windows:
        ok = fit[ids]
        both = np.flatnonzero(ok[:-1] & ok[1:])
        joined = np.zeros(len(ids) + longest, bool)
        joined[both] = has(shared.value, pair_hash(hashes[ids[both]], hashes[ids[both + 1]]))
        at = np.flatnonzero(joined[:-1] & joined[1:])
        length, going = np.full(len(at), 3), np.ones(len(at), bool)
        for k in range(2, longest - 1):
            going &= joined[at + k]
            length += going
        return at, length

    tables = [pairs.select("lang", "head", "data")]
    if longest > 2:
        tables.append(_frequent(_shards(docs, words, ranges, 3, longer_at), least, "phrases").select("lang", "head", "data"))
    return materialize(_rooted(frequent, tables), "phrase_counts"), totals


def _rooted(frequent: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The sum of the tables, with the count of the first word at each root; words without followers included."""

    def summed(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        parts = [Automaton([(total, (), ())]) if data is None else Automaton.unpack(data) for total, data in rows]
        yield (*key, union(parts).pack())

    none = F.lit(None)
    rows = frequent.select("lang", F.col("word").alias("head"), "total", none.cast("binary").alias("data"))
    for table in tables:
        rows = rows.unionByName(table.withColumn("total", none.cast("bigint")))
    return _by_key(rows, ["lang", "head"], ["total", "data"], summed, "lang string, head string, data binary")


def _queries(counts: DataFrame) -> DataFrame:
    """(lang, origin, head, data): the rests of the candidates of ``origin`` that begin with ``head``.

    The weight of a rest is the count of the candidate that has just ``origin``
    ahead of it, 0 where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, head, data in zip(*(c.to_pylist() for c in batch.columns)):
                wanted: dict[bytes, dict] = defaultdict(dict)
                for phrase, weight in Automaton.unpack(data).phrases():
                    for k in range(len(phrase)):
                        rests = wanted[phrase[k]]
                        rest = phrase[k + 1:]
                        rests[rest] = weight if not k else rests.get(rest, 0)
                if not wanted:
                    continue
                built = []
                for rests in wanted.values():
                    builder = Builder()
                    for rest in sorted(rests):
                        builder.add(rest, rests[rest])
                    built.append(builder.finish().pack())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(built)), pa.repeat(head, len(built)),
                     pa.array(list(wanted), pa.binary()).cast(pa.string()), pa.array(built, pa.binary())],
                    names=["lang", "origin", "head", "data"])

    return counts.select("lang", "head", "data").mapInArrow(run, "lang string, origin string, head string, data binary")


def _answers(counts: DataFrame) -> DataFrame:
    """(lang, head, other, data): counts of rests that ``head`` asked ``other`` for; without
    ``other``, the phrases of ``head`` that never occur but after one certain word.

    Where many words ask one, the questions are split and the counts repeated for each part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, None
        for batch in batches:
            out = []
            for lang, head, part, origin, data in zip(*(c.to_pylist() for c in batch.columns)):
                if origin is None:
                    key, known = (lang, head, part), Automaton.unpack(data)
                    continue
                assert key == (lang, head, part), "counts come first"
                found, alike = composed(Automaton.unpack(data), known)
                out.append((lang, origin, head, found.pack()))
                if alike:
                    builder = Builder()
                    for phrase in sorted(alike):
                        builder.add(phrase, 1)
                    out.append((lang, head, None, builder.finish().pack()))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["lang", "head", "other", "data"])

    parts = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    asked = _queries(counts).select("lang", "head", F.pmod(F.xxhash64("origin"), F.lit(SPLIT)).cast("int").alias("part"),
                                    "origin", "data")
    told = counts.select("lang", "head", parts.alias("part"), F.lit(None).cast("string").alias("origin"), "data")
    both = told.unionByName(asked).repartition("lang", "head", "part")
    order = [F.col("lang"), F.col("head"), F.col("part"), F.col("origin").asc_nulls_first()]
    return both.sortWithinPartitions(*order).mapInArrow(run, "lang string, head string, other string, data binary")


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase that is kept, cut where it scores lowest."""
    counts, totals = phrase_counts(docs, least, longest)
    small = metric(totals) <= MAX_BROADCAST_ROWS
    numbers = F.broadcast(totals) if small else totals
    answers = materialize(_answers(counts), "answers")
    own = counts.join(numbers, "lang").select("lang", "head", "n", F.lit(None).cast("string").alias("other"), "data", F.lit(0).alias("kind"))
    sent = answers.select("lang", "head", F.lit(None).cast("bigint").alias("n"), "other", "data",
                          F.when(F.col("other").isNull(), 1).otherwise(2).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, own, dropped, rests = None, 0, None, set(), {}
        for batch in batches:
            out = []
            for lang, head, number, other, data, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, head) != key:
                    if own is not None:
                        out.extend(scored(key, n, own, dropped, rests))
                    key, n, own, dropped, rests = (lang, head), number, Automaton.unpack(data), set(), {}
                elif kind == 1:
                    dropped.update(p for p, w in Automaton.unpack(data).phrases() if w)
                else:
                    rests[other.encode()] = Automaton.unpack(data)
            yield listed(out)
        if own is not None:
            yield listed(scored(key, n, own, dropped, rests))

    def scored(key: tuple, n: int, own: Automaton, dropped: set, rests: dict[bytes, Automaton]) -> Iterator[tuple]:
        lang, head = key

        def visit(state: int, phrase: tuple[bytes, ...], above: list[int]) -> Iterator[tuple]:
            weight, labels, targets = own.states[state]
            if phrase and phrase not in dropped and all(own.states[t][0] < weight for t in targets):
                best = None
                for k, first in enumerate(above):
                    rest = count(rests[phrase[k]], phrase[k + 1:])
                    score = 1000 * weight * n // (first * rest)
                    if best is None or score < best[-1]:
                        best = (weight, first, rest, n, score)
                yield (lang, b" ".join([head.encode(), *phrase]).decode(), *best)
            for label, target in zip(labels, targets):
                yield from visit(target, (*phrase, label), [*above, weight])

        return visit(own.root, (), [])

    def count(automaton: Automaton, phrase: tuple[bytes, ...]) -> int:
        state = automaton.root
        for word in phrase:
            state = automaton.arcs(state)[word]
        return automaton.states[state][0]

    def listed(rows) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["lang", "phrase", "a", "l", "r", "n", "score"])

    together = own.unionByName(sent).repartition("lang", "head").sortWithinPartitions("lang", "head", "kind", "other")
    return together.select("lang", "head", "n", "other", "data", "kind").mapInArrow(
        run, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = candidates(docs, least, longest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, count(*) AS f
  FROM words, range(1, 6) t(m), range(1, len(w) - m + 2) s(i) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
found AS (SELECT * FROM grams WHERE m > 1 AND f >= 100),
kept AS (SELECT * FROM found c WHERE NOT EXISTS (SELECT 1 FROM found b
  WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.f >= 100 * c.f AND strpos(' ' || b.g || ' ', ' ' || c.g || ' ') > 0)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, n, k,
    CAST(CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept c JOIN totals USING (lang), range(1, c.m) t(k)
  JOIN grams x ON x.lang = c.lang AND x.g = array_to_string(string_split(c.g, ' ')[:k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.g = array_to_string(string_split(c.g, ' ')[k + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best WHERE place = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
