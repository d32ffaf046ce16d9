"""Jaccard join of documents on word shingles, exact, without pairs inside dense groups.

A document is its set of distinct 5-word shingles, as sorted 64-bit hashes; equal
sets (a 128-bit digest) form one class, and only classes are joined.

* Prefix index. In one global order of shingles, those known to be common last,
  two sets that link share a shingle among the first n - ceil(4n/5) + 1 of the
  larger and the first m - ceil(8m/9) + 1 of the smaller. Which shingles count as
  common (at most ``MAX_COMMON``) affects the amount of work, never the result.
* Tiles. Sets under one shingle are cut into bands of size, so that links only
  join neighbouring bands. In each tile all sets are first compared with one of
  them, the centre of the band, and with that of the band below. Links found so
  far give components.
* Then every tile is searched for pairs between different components, first for the
  likeliest partner of each set in each other component. Tiles in which that left
  out a pair are searched again for all pairs between components as they are now; in
  the others every pair has been looked at. Pairs whose sizes allow a link are bounded from above by hashed bitmaps: bits that only one
  of two bitmaps has are shingles that only one set has. Very large tiles are cut
  into pairs of blocks.
* What passes a bound is verified by intersecting the sorted arrays.

Pairs within a component found by the centres are never formed, so the work of a
group of near copies grows with its size. All links between components are found
and verified, which makes the components exact.

Defined results: null and empty texts have no shingles and are linked with
nothing; with fewer than five words the whole sequence is the only shingle; a row
without an id is linked with nothing and has no component; repeated rows come back
repeatedly; an empty table gives no rows; columns besides ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cladeloom.llm.common import text_or_empty
from cladeloom.llm.components import components
from cladeloom.session import discard, materialize, metric

SHINGLE = 5
MAX_COMMON = 1 << 18
COMMON_AT = 8
MAX_RUN = 1 << 20
TILE = 4096
MAX_WIDTH = 1 << 13
PART = 1 << 18  # hashes counted or sent at once
MAX_BROADCAST_ROWS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:len(words) - size + 1 + k]) * _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def class_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def links(shared, a, b):
    """Whether sets of a and b shingles with ``shared`` in common link (J >= 0.8)."""
    return 9 * shared >= 4 * (a + b)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap in 64-bit words, about four bits per shingle."""
    width = min(MAX_WIDTH, max(64, 1 << (4 * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width; works on rows of bitmaps too."""
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def shared_bound(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bound of the shingles shared with each of ``others`` (equal widths)."""
    only_one = np.bitwise_count(one & ~others).sum(-1, dtype=np.int64)
    only_other = np.bitwise_count(others & ~one).sum(-1, dtype=np.int64)
    return np.minimum(n - only_one, sizes - only_other)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def by_ranges(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """All hashes of sorted ``sets``, about ``PART`` at a time; equal ones come together."""
    parts = 1 + sum(map(len, sets)) // PART
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(parts if sets else 0):
        yield np.concatenate([s[at[k]:at[k + 1]] for s, at in zip(sets, cuts)])


def describe(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, key, k, bits) per document, and rows (h, seen) of shingles frequent in a batch.

    ``bits`` is null where an earlier row of the batch has the same set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, keys, bits, known, held, total = [], [], [], set(), [], 0
            for text in batch.column(1):
                found = shingles(text.as_py())
                key = class_key(found)
                ns.append(len(found))
                keys.append(key)
                bits.append(None if key in known else bitmap(found).tobytes())
                if key not in known:
                    known.add(key)
                    held.append(found)
                    total += len(found)
                if total > 4_000_000:
                    yield from frequent(held)
                    held, total = [], 0
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(map(short_key, keys), pa.int64()), pa.array(bits, pa.binary()), none, none], names=names)
            yield from frequent(held)

    names = ["doc_id", "n", "key", "k", "bits", "h", "seen"]

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part in by_ranges(held):
            values, counts = np.unique(part, return_counts=True)
            often = counts >= 3
            size = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()),
                 pa.nulls(size, pa.binary()), _signed(values[often]), pa.array(counts[often])], names=names)

    return _rows(docs).mapInArrow(run, "doc_id bigint, n bigint, key binary, k bigint, bits binary, h bigint, seen bigint")


def common_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles, sorted, and the logarithm of their counts."""
    counted = materialize(
        described.filter("h IS NOT NULL").groupBy("h").agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") >= COMMON_AT)
        .select("h", F.floor(F.log2("seen")).cast("int").alias("level")),
        "common",
    )
    levels = counted.groupBy("level").count().orderBy(F.col("level").desc()).collect()
    total, least = 0, 64
    for row in levels:
        total += row["count"]
        if total > MAX_COMMON:
            break
        least = row["level"]
    rows = counted.filter(F.col("level") >= least).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    level = np.array([r["level"] for r in rows], np.uint8)
    order = np.argsort(h)
    return h[order], level[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, band, k, n): the prefix of each set; n is negative beyond the smaller set's prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, levels = shared.value
        for batch in batches:
            known, hs, ks, ns = set(), [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                n = len(found)
                key = class_key(found)
                if not n or key in known:
                    continue
                known.add(key)
                if len(values):
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    level = np.where(values[at] == found, levels[at], 0)
                    found = found[np.argsort(level, kind="stable")]
                probe, index = n + (-4 * n // 5) + 1, n + (-8 * n // 9) + 1
                hs.append(found[:probe].copy())  # not a view, which keeps the whole set
                ks.append(np.full(probe, short_key(key), np.int64))
                ns.append(np.where(np.arange(probe) < index, n, -n).astype(np.int32))
                if len(hs) >= 2_000:
                    yield _entries(hs, ks, ns)
                    hs, ks, ns = [], [], []
            if hs:
                yield _entries(hs, ks, ns)

    return _rows(docs).select("doc_id", "text").mapInArrow(run, "h bigint, band smallint, k bigint, n int")


def _entries(hs, ks, ns) -> pa.RecordBatch:
    n = np.concatenate(ns)
    band = np.floor(np.log(np.abs(n)) / np.log(1.25) + 1e-9).astype(np.int16)
    return pa.RecordBatch.from_arrays(
        [_signed(np.concatenate(hs)), pa.array(band), pa.array(np.concatenate(ks)), pa.array(n)],
        names=["h", "band", "k", "n"])


def _runs(entries: DataFrame) -> DataFrame:
    """(h, k, n, c0, c1, several): sets under one shingle, with the centres of their band and the band below.

    ``several`` tells that there are more than two; a shingle of more than
    ``MAX_RUN`` sets is placed in parts. The centres of a part come again in the
    next one, which connects the parts, and are not ``several`` there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, again = None, None, 0
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if not cut and len(rows[0]) > MAX_RUN:
                out, centres = placed(rows, rows[0][0], again)
                yield out
                held, part, again = [c[centres] for c in rows], rows[0][0], len(centres)
                continue
            if cut:
                yield placed([c[:cut] for c in rows], part, again)[0]
                again = 0
            held = [c[cut:] for c in rows]
        if held is not None and len(held[0]):
            yield placed(held, part, again)[0]

    def placed(rows: list[np.ndarray], part: int | None, again: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """``part``: a shingle placed in parts; the first ``again`` rows are centres of its part before."""
        h, band, k, n = rows
        seen = np.arange(len(h)) < again
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, band, k, n, seen = h[fresh], band[fresh], k[fresh], n[fresh], seen[fresh]
        new_run = np.ones(len(h), bool)
        new_run[1:] = h[1:] != h[:-1]
        new_band = new_run.copy()
        new_band[1:] |= band[1:] != band[:-1]
        starts, at = np.flatnonzero(new_band), np.cumsum(new_band) - 1
        draw = ((k ^ h).view(np.uint64) * _MIX) >> np.uint64(16)
        first = np.full(len(starts), len(h))
        np.minimum.at(first, at, np.where(draw == np.minimum.reduceat(draw, starts)[at], np.arange(len(h)), len(h)))
        below = np.arange(len(starts)) - 1
        joined = ~new_run[starts] & (band[starts] == band[starts[below]] + 1)
        lower = np.where(joined, first[below], first)
        sizes = np.diff(np.append(np.flatnonzero(new_run), len(h)))[np.cumsum(new_run) - 1]
        keep = sizes > 1
        out = pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (h, k, n, k[first[at]], k[lower[at]], ((sizes > 2) | (h == part)) & ~seen)],
            names=["h", "k", "n", "c0", "c1", "several"])
        return out, np.flatnonzero(fresh)[first]

    dealt = entries.repartition("h").sortWithinPartitions("h", "band", "k")
    return dealt.mapInArrow(run, "h bigint, k bigint, n int, c0 bigint, c1 bigint, several boolean")


def _hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, hashes) of the classes ``wanted`` (doc_id, key), from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, total = [], [], 0
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                found = shingles(text.as_py())
                if class_key(found) == key:
                    keys.append(key)
                    out.append(found.tobytes())
                    total += len(found)
                if total > PART:
                    yield sets(keys, out)
                    keys, out, total = [], [], 0
            yield sets(keys, out)

    def sets(keys: list[bytes], hashes: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "hashes"])

    small = metric(wanted) <= MAX_BROADCAST_ROWS
    texts = _rows(docs).join(F.broadcast(wanted) if small else wanted, "doc_id").select("text", "key")
    return texts.mapInArrow(run, "key binary, hashes binary")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of short keys that sizes and bitmaps allow to link, as class keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, va, vb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "va", "vb"))):
                x, y = np.frombuffer(va, np.uint64), np.frombuffer(vb, np.uint64)
                width = min(len(x), len(y))
                most = shared_bound(folded(x, width), na, folded(y, width), nb)
                keep.append(bool(links(most, na, nb)))
            yield batch.filter(pa.array(keep)).select(["ka", "kb"]).rename_columns(["a", "b"])

    side = lambda e: classes.select(*[F.col(c).alias(d + e) for c, d in (("k", ""), ("key", "k"), ("n", "n"), ("bits", "v"))])
    sized = F.col("na").between(F.floor(F.col("nb") * 4 / 5), F.ceil(F.col("nb") * 5 / 4))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(sized & (F.col("ka") != F.col("kb")))
    return joined.mapInArrow(run, "a binary, b binary").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of class keys among candidate pairs (a, b) of short keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for va, vb in zip(batch.column("va"), batch.column("vb")):
                x, y = np.frombuffer(va.as_py(), np.uint64), np.frombuffer(vb.as_py(), np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(bool(links(shared, len(x), len(y))))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    near = materialize(_bounded(pairs, classes), "near_pairs")
    ends = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = materialize(classes.select("doc_id", "key").join(ends, "key"), "wanted")
    sets = materialize(_hashes(docs, wanted), "sets")
    side = lambda e: sets.select(F.col("key").alias(e), F.col("hashes").alias("v" + e))
    found = near.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")
    found = materialize(found, "verified")
    discard(near, wanted, sets)
    return found


def _cross_pairs(tiles: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of different components under one tile that the bitmaps do not rule out.

    Rows (h) without a pair name the shingles of tiles in which ``best`` left out pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = np.stack([rows.column(c).to_numpy() for c in ("h", "i", "j")], 1)
            edges = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1)))
            yield from found(rows, edges)
            held = rows.slice(int(edges[-1]))
        if held is not None and held.num_rows:
            yield from found(held, np.array([0, held.num_rows]))

    def found(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, k, root, n, block = (rows.column(c).to_numpy() for c in ("h", "k", "root", "n", "block"))
        bits = rows.column("bits")
        for lo, hi in zip(edges, edges[1:]):
            if (root[lo:hi] == root[lo]).all():
                continue
            maps = [np.frombuffer(b.as_py(), np.uint64) for b in bits.slice(lo, hi - lo)]
            a, b, more = search_tile(k[lo:hi], root[lo:hi], n[lo:hi], block[lo:hi], maps, best)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=names)
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(h[lo:lo + 1])],
                                                 names=names)

    names = ["a", "b", "h"]

    dealt = tiles.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint, h bigint")


def search_tile(k, root, n, block, maps, best) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a tile with different roots, sizes that allow a link, and bitmaps that do.

    The third value tells whether ``best`` left out any such pair.

    ``n`` is negative where the shingle lies beyond the prefix of a smaller set. In
    a tile of two blocks only pairs across the blocks are looked at. With ``best``
    each set is paired with one set of each other component, that of the highest
    bound; a first round of these leaves few components for the search of all pairs.
    """
    size = np.abs(n)
    order = np.argsort(size, kind="stable")
    k, root, n, size, block = k[order], root[order], n[order], size[order], block[order]
    maps = [maps[i] for i in order]
    length = np.array([len(m) for m in maps])
    groups = {}
    for width in np.unique(length):
        at = np.flatnonzero(length == width)
        groups[int(width)] = (int(at[0]), np.stack([maps[i] for i in at]))
    two = len(np.unique(block)) > 1
    first, second, more = [], [], False
    for i in range(len(k)):
        end = int(np.searchsorted(size, size[i] * 5 // 4, side="right"))
        for width, (start, stack) in groups.items():
            lo, hi = max(i + 1, start), min(end, start + len(stack))
            if lo >= hi:
                continue
            other = np.flatnonzero(root[lo:hi] != root[i])
            if two:
                other = other[block[lo:hi][other] != block[i]]
            equal = size[lo:hi][other] == size[i]
            other = other[(n[i] > 0) | equal & (n[lo:hi][other] > 0)]
            if not len(other):
                continue
            shared_width = min(width, len(maps[i]))
            rows = folded(stack[lo - start + other], shared_width)
            most = shared_bound(folded(maps[i], shared_width), size[i], rows, size[lo:hi][other])
            fit = links(most, size[i], size[lo:hi][other])
            fits = other[fit]
            if best and len(fits) > 1:
                fits = fits[np.argsort(-most[fit] / size[lo:hi][fits], kind="stable")]
                likeliest = fits[np.unique(root[lo:hi][fits], return_index=True)[1]]
                more |= len(likeliest) < len(fits)
                fits = likeliest
            first.append(np.full(len(fits), k[i]))
            second.append(k[lo:hi][fits])
    none = np.empty(0, np.int64)
    return (np.concatenate(first), np.concatenate(second), more) if first else (none, none, more)


def _mixed(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, k, n, root, size): those of ``rows`` (h, k, n) under shingles with sets of several components."""
    labels = classes.select("k", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    labels = labels.select("k", F.xxhash64(F.coalesce("root", "key")).alias("root"))
    rooted = rows.select("h", "k", "n").join(labels, "k")
    of_tile = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size"))
    return materialize(rooted.join(of_tile.filter("x != y").select("h", "size"), "h"), "mixed")


def _tiles(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of each tile, cut into pairs of blocks, with their bitmaps."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    tiled = (
        mixed.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k", "root", "n", "block")
    )
    return tiled.join(classes.select("k", "bits"), "k")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components (node, root) after adding the links ``found`` (a, b) between nodes."""
    for end in ("a", "b"):
        at_end = roots.select(F.col("node").alias(end), F.col("root").alias("_r"))
        found = found.join(at_end, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    more = components(found)
    if more is None:
        return roots
    alone = more.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    later = more.select(F.col("node").alias("root"), F.col("root").alias("last"))
    joined = roots.unionByName(alone).join(later, "root", "left")
    return materialize(joined.select("node", F.coalesce("last", "root").alias("root")), "components")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key) of ``docs``, and classes (key, doc_id, root) with their least id."""
    described = materialize(describe(docs), "described")
    listed = described.filter("h IS NULL").select("doc_id", "n", "key")
    common = common_shingles(described)
    runs = materialize(_runs(prefixes(docs.filter("doc_id IS NOT NULL"), common)), "runs")

    known = described.filter("n > 0 AND doc_id IS NOT NULL")
    firsts = materialize(known.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "firsts")
    met = described.filter("n > 0 AND bits IS NOT NULL").join(runs.select("k").distinct(), "k", "left_semi")
    sketches = met.groupBy("key").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(sketches.join(firsts, "key"), "classes")

    centres = runs.select("k", F.explode(F.array("c0", "c1")).alias("c")).filter("k != c")
    pairs = centres.select(F.least("k", "c").alias("a"), F.greatest("k", "c").alias("b")).distinct()
    roots = firsts.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    roots = _merged(roots, _verified(docs, pairs, classes))
    rows, read = runs.filter("several"), runs
    for best in (True, False):
        rows = _mixed(rows, classes, roots)  # components only grow: tiles of one component stay so
        discard(read)
        crossing = materialize(_cross_pairs(_tiles(rows, classes), best), "crossing", again=F.count("h"))
        pairs = crossing.filter("h IS NULL").select("a", "b").distinct()
        roots, read = _merged(roots, _verified(docs, pairs, classes)), rows
        if not metric(crossing, "again"):
            break
        rows = rows.join(crossing.select("h").distinct(), "h", "left_semi")
    discard(read, crossing)

    rooted = firsts.join(roots, F.col("key") == F.col("node"), "left")
    rooted = rooted.select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    return listed, materialize(rooted, "rooted")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    listed, rooted = _linked(docs)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("key", "component_id")
    return listed.join(of_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"),
    )


@F.pandas_udf(BinaryType())
def class_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: class_key(shingles(t)))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows, that of the smallest id and key, with its columns.

    Rows without an id stay. Rows without shingles are linked with nothing; of those
    with one id one stays. Of rows with the same id and set the first by text stays,
    a null text last. Only rows of repeated ids need their key again.
    """
    listed, rooted = _linked(docs)
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("s")).select("s.*")
    empty = listed.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "key").distinct()
    kept = materialize(first.unionByName(empty), "kept")
    ids = listed.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    ids = materialize(ids, "repeated_ids")
    small = F.broadcast(ids) if metric(ids) <= MAX_BROADCAST_ROWS else ids
    whole = docs.join(kept.join(small, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    whole = whole.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
    if not metric(ids):
        return whole
    chosen = kept.join(small, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    rows = docs.join(small, "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), text_or_empty().alias("_text"),
        F.col("text").isNull().alias("_null"))
    rows = rows.withColumn("_key", class_of("_text")).join(chosen, ["_id", "_key"], "left_semi")
    single = rows.groupBy("_id", "_key").agg(F.min_by("_row", F.struct("_null", "_text")).alias("_row"))
    return whole.unionByName(single.select("_row.*"))


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.r = edges.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(min(r), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""
