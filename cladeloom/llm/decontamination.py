"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a SimHash over its word shingles, weighted by how often
each occurs. Documents that hold no stretch dense in benchmark shingles, judged row by
row with a bitmap of bounded size, are left out; no text is moved. Of the others every
window as long as an item is formed that can be similar to an item of that length:
8/9 of its shingles occur in such items, in any order and at any place. A window and
an item of its length are compared when they agree in one of ``RADIUS + 1`` blocks of
bits, which no pair within the radius can avoid; those within the radius are verified
by the exact weighted similarity of their shingles, the sum of the smaller over the
sum of the larger counts.

Defined results: null and empty texts and items hold nothing; an item of fewer
than five words has its whole word sequence as its only shingle; rows of one id
(null is an id, too) count as one document in ``search``, while ``clean`` removes
only the rows that hold an item themselves; repeated items are reported once
each id; without rows or items there are no hits; columns besides those named
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import text_or_empty
from cladeloom.session import materialize, metric

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 18
MAX_BROADCAST_ROWS = 200_000
MAX_BITS = 22


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each position on; none where fewer are left."""
    ahead = [F.slice(words, j + 1, F.greatest(F.size(words) - (k - 1), F.lit(0))) for j in range(k)]
    return F.transform(F.arrays_zip(*[a.alias(f"w{j}") for j, a in enumerate(ahead)]), lambda z: F.xxhash64(z))


def numbered(hashes: Column) -> Column:
    """The same shingles as a set: each with the number of equal ones before it."""
    return F.transform(
        hashes,
        lambda h, i: F.struct(h.alias("h"), F.size(F.filter(F.slice(hashes, 1, i), lambda g: g == h)).alias("k")),
    )


def simhash(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``keys`` and ``fp``: the sign of the summed weights of each bit."""
    each = rows.repartition(*keys).select(*keys, F.explode(hashes).alias("_h"))
    signs = [
        F.sum(F.shiftright("_h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{b}") for b in range(BITS)
    ]
    bit = lambda b: F.when(F.col(f"_b{b}") > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0))
    summed = each.groupBy(*keys).agg(*signs)
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(BITS))).alias("fp"))


def blocks(fp: Column, count: int) -> Column:
    """The bits of ``fp`` in ``count`` blocks, each with its number."""
    edges = [k * BITS // count for k in range(count + 1)]
    return F.array(*[
        F.struct(F.lit(k).alias("k"),
                 F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
        for k, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, k, hashes): word count, shingle length and shingles of each distinct item."""
    words = benchmark.select("item_id", words_of(text_or_empty()).alias("words")).filter(F.size("words") > 0)
    found = words.select("item_id", "words", F.size("words").alias("n"),
                         F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))
    cases = F.coalesce(*[F.when(F.col("k") == k, shingle_hashes(F.col("words"), k)) for k in range(1, SHINGLE + 1)])
    return found.select("item_id", "n", "k", cases.alias("hashes")).distinct()


def digest() -> Column:
    """With ``doc_id`` the key of a row; equal rows share it and their result."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def bitmap_of(hashes: DataFrame, count: int) -> tuple[Column, int]:
    """A bit for every hash modulo a power of two, as a constant of bounded size, and its number of 64-bit words."""
    words = 1 << min(MAX_BITS - 6, max(6, (count - 1).bit_length()))  # about 64 bits a hash
    place = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1)).alias("place")
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")
    rows = hashes.select(place, bit).groupBy("place").agg(F.bit_or("bit").alias("bits")).collect()
    listed = [0] * words
    for row in rows:
        listed[row["place"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, listed))), ",").cast("array<bigint>"), words


def in_bitmap(hashed: Column, bits: tuple[Column, int]) -> Column:
    listed, words = bits
    word = F.get(listed, F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(words - 1)).cast("int"))
    return F.bit_get(word, hashed.bitwiseAND(F.lit(63)).cast("int")) == 1


def dense_stretches(sizes: list[int]) -> list[tuple[int, int]]:
    """(marks, span): of every window that can be similar to an item of one of ``sizes`` shingles,
    one of these holds: so many of its shingles, within so many places, occur in items.
    """
    found, ordered = [], sorted(sizes)
    while ordered:
        low, high = ordered[0], ordered[0]
        while ordered and ordered[0] <= max(low, low * 1.15):
            high = ordered.pop(0)
        found.append((-(-4 * low // 5), high))
    return found


def _suspects(docs: DataFrame, shingles: DataFrame, k: int, sizes: list[int]) -> DataFrame:
    """(doc_id, digest, k, hashes): the shingles of documents that may hold an item, judged in the row itself."""
    bits = bitmap_of(shingles.filter(F.col("k") == k), metric(shingles))
    stretches = dense_stretches(sizes)
    least = min(marks for marks, _ in stretches)
    wanted = F.array(*[F.struct(F.lit(a).alias("marks"), F.lit(b).alias("span")) for a, b in stretches])

    def dense(at: Column) -> Column:
        def within(s: Column) -> Column:
            firsts = F.when(F.size(at) >= s["marks"], F.sequence(F.lit(0), F.size(at) - s["marks"])).otherwise(F.array().cast("array<int>"))
            return F.exists(firsts, lambda i: F.get(at, i + s["marks"] - 1) - F.get(at, i) < s["span"])

        return F.exists(wanted, within)

    def marked(hashes: Column) -> Column:
        places = F.filter(F.transform(hashes, lambda h, i: F.when(in_bitmap(h, bits), i)), lambda i: i.isNotNull())
        enough = F.size(F.filter(hashes, lambda h: in_bitmap(h, bits))) >= least
        return F.when(enough & let(places, dense), hashes)

    kept = let(words_of(text_or_empty()), lambda w: let(shingle_hashes(w, k), marked))
    rows = docs.select("doc_id", digest().alias("digest"), F.lit(k).alias("k"), kept.alias("hashes")).filter("hashes IS NOT NULL")
    return rows.groupBy("doc_id", "digest", "k").agg(F.first("hashes").alias("hashes"))


def _windows(suspects: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, digest, k, n, start, hashes): item-sized windows that can be similar to an item of their size.

    A window of m shingles and an item of as many are similar only when 8m/9 of the
    shingles of the window occur in items of that size, wherever they lie in it. A
    window at the end of a document may be shorter.
    """
    shingles = items.select("k", "n", F.explode("hashes").alias("h")).distinct()
    shingles = materialize(shingles, "benchmark_shingles")
    small = F.broadcast(shingles) if metric(shingles) <= MAX_BROADCAST_ROWS else shingles
    each = suspects.select("doc_id", "digest", "k", F.size("hashes").alias("all"), F.posexplode("hashes").alias("pos", "h"))
    marks = each.join(small, ["k", "h"]).groupBy("doc_id", "digest", "k", "n", "all").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    m, at = F.col("n") - F.col("k") + 1, F.col("at")
    size = F.least(m, F.col("all"))
    needed = F.ceil((m + size) * 4 / 9 - 1e-9).cast("int")
    marks = marks.select("*", size.alias("size"), needed.alias("needed")).filter(F.size("at") >= F.ceil(m * 4 / 5 - 1e-9))

    def starts(i: Column) -> Column:
        """Starts after the mark before i, up to mark i, that have enough marks from i on."""
        low = F.greatest(F.get(at, i + F.col("needed") - 1) - F.col("size") + 1, F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.lit(0))
        high = F.least(F.get(at, i), F.col("all") - F.col("size"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def ends_there(p: Column) -> Column:
        marked = F.size(F.filter(at, lambda a: a >= p))
        return marked >= F.ceil((m + F.col("all") - p) * 4 / 9 - 1e-9)

    firsts = F.when(F.size("at") >= F.col("needed"), F.sequence(F.lit(0), F.size("at") - F.col("needed"))).otherwise(
        F.array().cast("array<int>"))
    low, high = F.greatest(F.col("all") - m + 1, F.lit(0)), F.col("all") - F.ceil(m * 4 / 5 - 1e-9).cast("int")
    last = F.when(low <= high, F.filter(F.sequence(low, high), ends_there)).otherwise(F.array().cast("array<int>"))
    found = F.array_distinct(F.concat(F.flatten(F.transform(firsts, starts)), last))
    placed = marks.select("doc_id", "digest", "k", "n", "size", F.explode(found).alias("start"))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.digest") == F.col("y.digest")) & (F.col("x.k") == F.col("y.k"))
    joined = placed.alias("x").join(suspects.alias("y"), same)
    window = F.slice("y.hashes", F.col("x.start") + 1, F.col("x.size"))
    return joined.select("x.doc_id", "x.digest", "x.k", "x.n", "x.start", window.alias("hashes"))


def _hits(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(doc_id, digest, item_id, similarity, start) of all windows that hold an item."""
    items = materialize(items_of(benchmark), "benchmark_items")
    sizes = {r["k"]: r["sizes"] for r in items.groupBy("k").agg(F.collect_set(F.col("n") - F.col("k") + 1).alias("sizes")).collect()}
    if not sizes:
        return docs.select("doc_id", digest().alias("digest"), F.lit(None).cast("bigint").alias("item_id"),
                           F.lit(0.0).alias("similarity"), F.lit(0).alias("start")).limit(0)
    shingles = materialize(items.select("k", F.explode("hashes").alias("h")).distinct(), "benchmark_hashes")
    suspects = reduce(DataFrame.unionByName, [_suspects(docs, shingles, k, sizes[k]) for k in sorted(sizes)])
    suspects = materialize(suspects, "suspects")
    windows = _windows(suspects, items).withColumn("id", F.xxhash64("k", "n", "hashes"))
    windows = materialize(windows, "windows")

    texts = windows.dropDuplicates(["id"]).select("id", "k", "n", "hashes")
    window_prints = simhash(texts, ["id", "k", "n"], "hashes")
    item_prints = simhash(items.withColumn("id", F.xxhash64("item_id", "k", "n", "hashes")), ["id", "k", "n"], "hashes")
    left = window_prints.select("id", "k", "n", "fp", F.explode(blocks(F.col("fp"), radius + 1)).alias("b"))
    right = item_prints.select(F.col("id").alias("item"), "k", "n", F.col("fp").alias("item_fp"),
                               F.explode(blocks(F.col("fp"), radius + 1)).alias("b"))
    near = (
        left.join(right, ["k", "n", "b"])
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("id", "item").distinct()
    )
    known = items.select(F.xxhash64("item_id", "k", "n", "hashes").alias("item"), "item_id",
                         numbered(F.col("hashes")).alias("theirs"))
    pairs = near.join(texts.select("id", "hashes"), "id").join(known, "item")
    shared = F.size(F.array_intersect("ours", "theirs"))
    similar = (
        pairs.withColumn("ours", numbered(F.col("hashes")))
        .withColumn("similarity", shared / (F.size("ours") + F.size("theirs") - shared))
        .filter(F.col("similarity") >= similarity)
        .select("id", "item_id", "similarity")
    )
    return windows.select("doc_id", "digest", "start", "id").join(similar, "id").select(
        "doc_id", "digest", "item_id", "similarity", "start")


def search(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window of each document and item found in it."""
    return (
        _hits(docs, benchmark, similarity, radius)
        .groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"))
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark item in them, whatever other columns they have.

    Hits that are few are broadcast. Else rows that a bitmap of all hits rules out
    stay where they are, and only the rest is joined.
    """
    name, key = unused(docs, "_id"), unused(docs, "_digest")
    hits = _hits(docs, benchmark, SIMILARITY, RADIUS).select(F.col("doc_id").alias(name), F.col("digest").alias(key)).distinct()
    hits = materialize(hits, "hits")
    same = docs["doc_id"].eqNullSafe(hits[name]) & (digest() == hits[key])
    if metric(hits) <= MAX_BROADCAST_ROWS:
        return docs.join(F.broadcast(hits), same, "left_anti")
    bits = bitmap_of(hits.select(F.xxhash64(name, key).alias("h")), metric(hits))
    maybe = in_bitmap(F.xxhash64(F.col("doc_id"), digest()), bits)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(hits, same, "left_anti"))
