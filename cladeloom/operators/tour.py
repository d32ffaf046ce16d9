"""Pattern order along a minimum spanning tree: neighbours differ in few taxa.

The tree grows by distance. Patterns at a distance of d or less agree when some d
taxa are masked, so of the patterns under one masked key each is linked with the
least of them: a star spans what all pairs would. Between components that hold
together at less than d every such link has length d, and rounds of least links
(one per component, then contraction) take those that the tree needs. Where masks
would be more than ``MASKS`` a pattern, the components left are joined along
neighbours in ``TURNS`` rotated lexicographic orders, the shortest links first; for
alignments of up to 14 taxa the tree is always a minimum spanning tree.

The walk over the tree, by list ranking, gives the order. Nothing depends on how
rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.operators.linked import preorder
from cladeloom.operators.patterns import hamming
from cladeloom.operators.ranking import MAX_WINDOW_ROWS, global_rank, with_previous
from cladeloom.session import materialize, metric

MASKS = 4096
TURNS = 8


def _masked(placed: DataFrame, taxa: int, d: int) -> DataFrame:
    """(key, id, comp): every pattern with each choice of ``d`` taxa masked."""
    rows = placed.select("id", "comp", F.col("pattern").alias("key"), F.lit(-1).alias("_last"))
    for k in range(d):
        ahead = F.explode(F.sequence(F.col("_last") + 1, F.lit(taxa - d + k))).alias("_at")
        rows = rows.select("id", "comp", "key", ahead).select(
            "id", "comp", F.overlay("key", F.lit("*"), F.col("_at") + 1).alias("key"), F.col("_at").alias("_last"))
    return rows.select("key", "id", "comp")


def _links_at(placed: DataFrame, taxa: int, d: int) -> DataFrame:
    """(x, y, w, a, b): of patterns a and b under one mask in different components x and y, stars."""
    rows = _masked(placed, taxa, d)
    groups = rows.groupBy("key").agg(
        F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min(F.struct("id", "comp")).alias("centre"))
    mixed = groups.filter("_low <> _high").select("key", "centre")
    star = rows.join(mixed, "key").filter(F.col("comp") != F.col("centre.comp"))
    return star.select(F.col("comp").alias("x"), F.col("centre.comp").alias("y"), F.lit(d).alias("w"),
                       F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b"))


def _links_beside(placed: DataFrame, taxa: int) -> DataFrame:
    """The same between neighbours in rotated lexicographic orders."""
    found = []
    for turn in range(min(TURNS, taxa)):
        cut = turn * taxa // min(TURNS, taxa)
        turned = F.concat(F.substring("pattern", cut + 1, taxa), F.substring("pattern", 1, cut))
        ranked = global_rank(placed.select("id", "comp", "pattern"), [turned], "_rank")
        beside = with_previous(ranked, "_rank", ["id", "comp", "pattern"]).filter(F.col("comp") != F.col("prev_comp"))
        found.append(beside.select(
            F.col("comp").alias("x"), F.col("prev_comp").alias("y"), hamming(F.col("pattern"), F.col("prev_pattern")).cast("int").alias("w"),
            F.least("id", "prev_id").alias("a"), F.greatest("id", "prev_id").alias("b")))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _tidy(links: DataFrame) -> DataFrame:
    """Of the links between two components the least, once."""
    x, y = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    best = links.filter("x <> y").select(x, y, F.struct("w", "a", "b").alias("e")).groupBy("x", "y").agg(F.min("e").alias("e"))
    return best.select("x", "y", "e.*")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree edges (w, a, b) and moves (x, to) of links that one task holds, shortest links first."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    edges = []
    for w, a, b, x, y in zip(*(rows.column(c).to_pylist() for c in ("w", "a", "b", "x", "y"))):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            edges.append((w, a, b, None, None))
    moved = [(None, None, None, x, top(x)) for x in list(above)]
    kinds = [pa.int32(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*edges, *moved), kinds)], names=["w", "a", "b", "x", "to"])


def least_links(links: DataFrame, max_rows: int = MAX_WINDOW_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tree edges (w, a, b) that join the components x and y of ``links``, and moves (x, to), round by round.

    Links are in one total order (w, a, b), so the edges are the same whichever way they
    are found: up to ``max_rows`` links, as counted, in one task; more in rounds, where
    the least ones of all components never close a circle but between two that choose
    each other.
    """
    trees, moves = [], []
    links = materialize(_tidy(links), "links")
    if 0 < metric(links) <= max_rows:
        done = links.repartition(1).mapInArrow(_joined, "w int, a bigint, b bigint, x bigint, to bigint")
        done = materialize(done, "joined")
        return [done.filter("w IS NOT NULL").select("w", "a", "b")], [done.filter("w IS NULL").select("x", "to")]
    while metric(links):
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "w", "a", "b"))
        chosen = materialize(
            both.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.*"), "chosen")
        trees.append(chosen.select("w", "a", "b").distinct())
        mate = chosen.select(F.col("x").alias("y"), F.col("y").alias("_back"))
        to = F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y"))
        moved = materialize(chosen.join(mate, "y").select("x", to.alias("to")), "moves", open=F.lit(1).cast("bigint") * F.sum(
            (F.col("x") != F.col("to")).cast("bigint")))
        changed = metric(moved, "open")
        while changed:
            up = moved.select(F.col("x").alias("to"), F.col("to").alias("_up"))
            jumped = moved.join(up, "to").select("x", F.col("_up").alias("to"), (F.col("_up") != F.col("to")).alias("_moved"))
            moved = materialize(jumped, "moves", open=F.sum(F.col("_moved").cast("bigint")))
            changed = metric(moved, "open")
        moved = moved.select("x", "to")
        moves.append(moved)
        left = moved.withColumnRenamed("to", "_x")
        right = moved.select(F.col("x").alias("y"), F.col("to").alias("_y"))
        links = materialize(_tidy(links.join(left, "x").join(right, "y").select(
            F.col("_x").alias("x"), F.col("_y").alias("y"), "w", "a", "b")), "links")
    return trees, moves


def spanning_tree(patterns: DataFrame, max_rows: int = MAX_WINDOW_ROWS) -> tuple[DataFrame, DataFrame]:
    """Patterns (id, pattern, freq), numbered in lexicographic order, and tree edges (w, a, b) between them."""
    ranked = materialize(global_rank(patterns.select("pattern", "freq"), [F.col("pattern")], "id"), "patterns",
                         taxa=F.max(F.length("pattern")))
    total, taxa = metric(ranked), metric(ranked, "taxa") or 0
    placed = ranked.select("id", "pattern", F.col("id").alias("comp"))
    tree = ranked.select(F.lit(0).alias("w"), F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    found, d = 0, 1
    while found < total - 1:
        masked = d <= taxa and comb(taxa, d) <= MASKS
        trees, moves = least_links(_links_at(placed, taxa, d) if masked else _links_beside(placed, taxa), max_rows)
        for more in trees:
            tree = tree.unionByName(more)
        for moved in moves:
            placed = placed.join(moved.withColumnRenamed("x", "comp"), "comp", "left").select(
                "id", "pattern", F.coalesce("to", "comp").alias("comp"))
        if moves:
            tree = materialize(tree, "tree")
            found = metric(tree)
            placed = materialize(placed, "placed") if found < total - 1 else placed
        d += 1
    return ranked, tree


def tour_order(patterns: DataFrame) -> DataFrame:
    """(pattern_id, pattern, freq) of distinct patterns, in the order of a walk over the spanning tree."""
    ranked, tree = spanning_tree(patterns)
    roots = ranked.filter("id = 0").select(F.col("id").alias("node"))
    walk = preorder(tree, roots).select(F.col("node").alias("id"), F.col("place").alias("pattern_id"))
    return ranked.join(walk, "id").select("pattern_id", "pattern", "freq")
