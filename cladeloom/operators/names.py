"""Closest taxon for a name: equal, then up to punctuation, then case, then distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.functions.names import lower_ascii, name_distance, strip_punctuation
from cladeloom.session import materialize, metric, spread

# Kinds of match, best first.
EXACT, PUNCTUATION, CASE, DISTANCE = "exact", "punctuation", "case", "distance"

BLOCK_ROWS = 20_000
REACHES = (1, 3)
POSITIONS = 256
MAX_MASKS = 64  # sets of foreign places looked up by joins; names with rarer ones go the other ways
PAIR_COST = 64  # how many comparisons in a block one joined pair costs, a guess on the safe side


def _lookup(queries: DataFrame, candidates: DataFrame, fold, kind: str, rank: int) -> DataFrame:
    """Lowest candidate with an equal folded name; one equi-join on a unique key."""
    best = candidates.select(fold(F.col("name")).alias("_key"), "idx").groupBy("_key").agg(
        F.min("idx").alias(f"_i{rank}")
    )
    return queries.withColumn("_key", fold(F.col("query"))).join(best, "_key", "left").drop("_key")


def match_names(queries: DataFrame, candidates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, idx, kind, distance) for distinct names in ``queries.query``.

    ``candidates``: (idx, name), equal names counted as one with the lowest idx. Folded
    matches are joins. Names without one are looked up without their foreign bytes
    (``closest_by_masks``), then by equal pieces where these tell candidates apart
    (``closest_by_pieces``), and what has none within the last reach is compared with
    all candidates, chunk of names against block of candidates; a task returns its
    best candidate per name, never the pairs. Without any candidate idx is -1.
    """
    distinct = queries.select("query").distinct()
    candidates = materialize(candidates.groupBy("name").agg(F.min("idx").alias("idx")).select("idx", "name"), "candidates")
    found = _lookup(distinct, candidates, lambda c: c, EXACT, 0)
    found = _lookup(found, candidates, strip_punctuation, PUNCTUATION, 1)
    found = materialize(_lookup(found, candidates, lower_ascii, CASE, 2), "folded")
    folded = F.coalesce("_i0", "_i1", "_i2")
    kind = (
        F.when(F.col("_i0").isNotNull(), EXACT)
        .when(F.col("_i1").isNotNull(), PUNCTUATION)
        .otherwise(CASE)
    )
    easy = found.filter(folded.isNotNull()).select(
        "query", folded.alias("idx"), kind.alias("kind"), F.lit(0).cast("bigint").alias("distance")
    )
    rest = materialize(found.filter(folded.isNull()).select("query"), "unmatched")
    near, far = closest_by_masks(rest, candidates)
    reaches = _worthwhile_reaches(far, candidates) if metric(far) else ()
    if reaches:
        by_pieces, far = closest_by_pieces(far, candidates, reaches)
        near = near.unionByName(by_pieces.select("query", "idx", "distance"))
    if metric(far):
        near = near.unionByName(closest_by_distance(far, candidates, block_rows))
    hard = rest.join(near, "query", "left").select(
        "query",
        F.coalesce("idx", F.lit(-1)).cast("bigint").alias("idx"),
        F.lit(DISTANCE).alias("kind"),
        "distance",
    )
    return easy.unionByName(hard)


def bytes_at(candidates: DataFrame) -> DataFrame:
    """(at, b, count): how many names have byte ``b`` at place ``at``, from 1 up to ``POSITIONS``."""
    raw = F.encode("name", "UTF-8")
    at = F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.length(raw), F.lit(1)), F.lit(POSITIONS)))).alias("at")
    return candidates.select(raw.alias("raw"), at).groupBy("at", F.substring("raw", F.col("at"), 1).alias("b")).count()


def closest_by_masks(
    names: DataFrame, candidates: DataFrame, max_masks: int = MAX_MASKS
) -> tuple[DataFrame, DataFrame]:
    """Exact nearest candidates (query, idx, distance) by the least distance possible, and names (query) without one.

    A byte that no candidate has at its place differs from all of them, so a name with f
    such foreign bytes is f away at least. Candidates that are equal elsewhere are exactly
    f away: an equi-join on the bytes outside the mask of foreign places. Names with
    masks rarer than the first ``max_masks`` are returned as without one.
    """
    seen = np.zeros((POSITIONS, 256), bool)
    for row in bytes_at(candidates).select("at", "b").collect():
        if row["b"]:
            seen[row["at"] - 1, row["b"][0]] = True

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, keys = [], []
            for name in batch.column("query").to_pylist():
                raw = np.frombuffer(name.encode(), np.uint8)
                head = np.flatnonzero(~seen[np.arange(min(len(raw), POSITIONS)), raw[:POSITIONS]])
                masks.append(",".join(map(str, head)))
                keys.append(np.delete(raw, head).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), pa.array(masks, pa.string()), pa.array(keys, pa.binary())], names=["query", "mask", "key"])

    names = materialize(names.select("query"), "names")
    marked = materialize(names.filter("query IS NOT NULL").mapInArrow(mark, "query string, mask string, key binary"), "marked")
    frequent = marked.filter("mask != ''").groupBy("mask").count().orderBy(F.desc("count"), "mask").limit(max_masks)
    chosen = [(row["mask"], [int(at) for at in row["mask"].split(",")]) for row in frequent.collect()]

    def without(places: list[int]) -> Column:
        starts = [0, *(at + 1 for at in places)]
        return F.concat(*[F.substring(raw, lo + 1, hi - lo) for lo, hi in zip(starts, [*places, 1 << 30])])

    raw = F.encode("name", "UTF-8")
    cut = [F.struct(F.lit(mask).alias("mask"), without(places).alias("key")) for mask, places in chosen]
    if not cut:
        return names.limit(0).select("query", F.lit(0).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("distance")), names
    keyed = candidates.filter("name IS NOT NULL").select(F.col("idx").cast("bigint").alias("idx"), F.inline(F.array(*cut))).groupBy(
        "mask", "key").agg(F.min("idx").alias("idx"))
    size = F.size(F.split("mask", ",")).cast("bigint").alias("distance")
    near = materialize(marked.join(keyed, ["mask", "key"]).select("query", "idx", size), "near_names")
    return near, materialize(names.join(near, "query", "left_anti"), "names")


def _worthwhile_reaches(names: DataFrame, candidates: DataFrame) -> tuple[int, ...]:
    """The reaches whose pieces join far fewer pairs than there are; counted, not joined."""
    every = metric(names) * metric(candidates)
    bounds = piece_bounds(candidates, [r + 1 for r in REACHES])
    kept = []
    for reach in REACHES:
        asked, there = (_cut(df, name, bounds[reach + 1]).groupBy("piece", "key").agg(F.count("*").cast("double").alias(f"_{name}"))
                        for df, name in ((names, "query"), (candidates, "name")))
        pairs = asked.join(there, ["piece", "key"]).agg(F.sum(F.col("_query") * F.col("_name"))).first()[0]
        if (pairs or 0) * PAIR_COST <= every:
            kept.append(reach)
    return tuple(kept)


def _cut(df: DataFrame, name: str, starts: list[int]) -> DataFrame:
    """The pieces (piece, key) of every name, with the size of the whole name."""
    raw = F.encode(name, "UTF-8")
    ends = [*starts[1:], None]
    keys = [F.struct(F.lit(k).alias("piece"), F.substring(raw, lo + 1, (1 << 30) if hi is None else hi - lo).alias("key"))
            for k, (lo, hi) in enumerate(zip(starts, ends))]
    return df.select("*", F.length(raw).alias(f"_{name}_size"), F.explode(F.array(*keys)).alias("_p")).select(
        *df.columns, f"_{name}_size", "_p.piece", "_p.key")


def piece_bounds(candidates: DataFrame, pieces: list[int]) -> dict[int, list[int]]:
    """For each number of pieces, where they begin, so that all tell candidates apart about equally well.

    What a byte position tells is its entropy over the candidates. Positions from
    ``POSITIONS`` on belong to the last piece.
    """
    share = F.col("count") / F.sum("count").over(Window.partitionBy("at"))
    entropy = bytes_at(candidates).withColumn("_h", -share * F.log2(share)).groupBy("at").agg(F.sum("_h").alias("h"))
    told = np.zeros(POSITIONS + 1)
    for row in entropy.collect():
        told[row["at"]] = row["h"]
    total = np.cumsum(told + 1e-6)
    bounds = {}
    for n in pieces:
        starts = [0]
        for k in range(1, n):  # no piece is empty, so none is equal for all names
            starts.append(max(starts[-1] + 1, int(np.searchsorted(total, total[-1] * k / n))))
        bounds[n] = starts
    return bounds


def closest_by_pieces(
    names: DataFrame, candidates: DataFrame, reaches: tuple[int, ...] = REACHES
) -> tuple[DataFrame, DataFrame]:
    """Exact nearest candidates (query, idx, distance, pairs) within the last reach, and names (query) without one.

    Two names at a distance of r or less, bytes compared place by place, agree in one
    of r + 1 pieces cut at the same places, and their lengths differ by r at most. So
    an equi-join on numbered pieces meets all candidates within r; a name whose
    nearest lies there is done, the others go on to the next reach. ``pairs`` counts
    the candidates compared for a name.
    """
    candidates = materialize(candidates.select("idx", "name"), "candidates")
    bounds = piece_bounds(candidates, [r + 1 for r in reaches])
    found, pending = [], materialize(names.select("query"), "names")
    for reach in reaches:
        starts = bounds[reach + 1]
        pairs = _cut(pending, "query", starts).join(_cut(candidates, "name", starts), ["piece", "key"]).filter(
            F.abs(F.col("_query_size") - F.col("_name_size")) <= reach)
        gap = name_distance(F.col("query"), F.col("name"))
        best = pairs.select("query", F.struct(gap.alias("distance"), "idx").alias("b")).groupBy("query").agg(
            F.min("b").alias("b"), F.count("*").alias("pairs")).filter(F.col("b.distance") <= reach)
        best = materialize(best.select("query", "b.idx", F.col("b.distance").cast("bigint").alias("distance"), "pairs"), "near_names")
        found.append(best)
        pending = materialize(pending.join(best, "query", "left_anti"), "names")
        if not metric(pending):
            break
    return reduce(DataFrame.unionByName, found), pending


def closest_by_distance(names: DataFrame, candidates: DataFrame, block_rows: int) -> DataFrame:
    """Exact nearest candidate (lowest idx among ties) of each name."""
    def pieces(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    chunks, blocks = pieces(names), pieces(candidates)

    def part(key: Column, n: int, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = names.select("query", part(F.col("query"), chunks, "chunk"), every(blocks, "block"))
    right = candidates.select(
        "idx", "name", part(F.col("idx"), blocks, "block"), every(chunks, "chunk")
    )
    left, right = (spread(side, "chunk", "block").groupBy("chunk", "block") for side in (left, right))
    best = left.cogroup(right).applyInPandas(
        _best_of_block, "query string, idx bigint, distance bigint"
    )
    nearest = F.min(F.struct("distance", "idx")).alias("b")
    return best.groupBy("query").agg(nearest).select("query", "b.idx", "b.distance")


def _padded(names: pd.Series, fill: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [n.encode() for n in names]
    sizes = np.array([len(r) for r in raw])
    grid = np.full((len(raw), sizes.max(initial=1)), fill, dtype=np.int16)
    for k, r in enumerate(raw):
        grid[k, : len(r)] = np.frombuffer(r, np.uint8)
    return grid, sizes


def _best_frame(queries: list, picks: list, gaps: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query": pd.Series(queries, dtype=object),
            "idx": pd.Series(picks, dtype=np.int64),
            "distance": pd.Series(gaps, dtype=np.int64),
        }
    )


def _best_of_block(names: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    if names.empty or candidates.empty:
        return _best_frame([], [], [])
    candidates = candidates.sort_values("idx")
    grid, sizes = _padded(candidates["name"], -1)
    wanted, wanted_sizes = _padded(names["query"], -2)
    width = min(grid.shape[1], wanted.shape[1])
    columns = np.ascontiguousarray(grid[:, :width].T)
    picks, gaps = [], []
    for row, size in zip(wanted[:, :width], wanted_sizes):
        gap = np.maximum(sizes, size) - (columns == row[:, None]).sum(axis=0)
        at = int(gap.argmin())
        picks.append(int(candidates["idx"].iloc[at]))
        gaps.append(int(gap[at]))
    return _best_frame(names["query"].tolist(), picks, gaps)


def rename_leaves(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Leaf labels become the closest taxon's name; inner labels are dropped.

    ``taxa``: (taxon_id, taxon).
    """
    candidates = taxa.select(F.col("taxon_id").alias("idx"), F.col("taxon").alias("name"))
    leaves = nodes.filter("is_leaf")
    matched = match_names(leaves.select(F.col("label").alias("query")), candidates)
    named = matched.join(candidates, "idx", "left").select(
        F.col("query").alias("label"), F.col("name").alias("_name"), F.col("idx").alias("_taxon"),
        "kind",
    )
    return (
        nodes.join(named, "label", "left")
        .withColumn("tree_label", F.col("label"))
        .withColumn("taxon_id", F.when(F.col("is_leaf"), F.col("_taxon")))
        .withColumn("label", F.when(F.col("is_leaf"), F.col("_name")))
        .withColumn("kind", F.when(F.col("is_leaf"), F.col("kind")))
        .drop("_name", "_taxon")
    )
