"""Walks over trees of any shape by list ranking: no paths, no recursion, no group in one task.

An undirected tree becomes a list of arcs, its Euler tour, in which the arc into a
node is followed by the arc to the next neighbour of that node. Positions in
the list come from pointer doubling, whose rounds grow with the logarithm of
the length, whatever the depth or the degree of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.operators.ranking import MAX_WINDOW_ROWS, global_rank, with_previous
from cladeloom.session import materialize, metric


def list_ranks(links: DataFrame, max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """(id, left): how many elements follow each in its list; ``links`` has (id, next), null at an end.

    Several lists may be ranked at once. A list that runs in a circle has no end;
    its elements keep a place that is still ahead and are left out. Up to
    ``max_rows`` elements, as counted, are doubled inside one task, more by joins.
    """
    one = F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint")
    now = materialize(links.select("id", "next", one.alias("left")), "list", open=F.count("next"))
    if metric(now) <= max_rows:
        return now.repartition(1).mapInArrow(_ranked, "id bigint, left bigint")
    total, steps = metric(now), 1
    while metric(now, "open") and steps <= total:
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        joined = now.join(ahead, "next", "left")
        moved = joined.select("id", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"))
        now, steps = materialize(moved, "list", open=F.count("next")), steps * 2
    return now.filter(F.col("next").isNull()).select("id", "left")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    ids, left = ids[order], table.column("left").to_numpy()[order]
    at = np.searchsorted(ids, table.column("next").fill_null(-1).to_numpy()[order])
    at[left == 0] = len(ids)  # a place after the last, which leads to itself
    at, left, steps = np.append(at, len(ids)), np.append(left, 0), 1
    while steps <= len(ids):
        left, at, steps = left + left[at], at[at], steps * 2
    ended = at[:-1] == len(ids)
    yield pa.RecordBatch.from_arrays([pa.array(ids[ended]), pa.array(left[:-1][ended])], names=["id", "left"])


def preorder(edges: DataFrame, roots: DataFrame, max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """(root, node, parent, place): every tree walked from its root, neighbours in ascending order.

    ``edges``: (a, b) of a forest; ``roots``: (node), one of each tree. ``place``
    counts from 0 along all trees, ordered by root; the rest of a tree follows its
    root, children after their parent and before its next child.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = materialize(global_rank(both, [F.col("a"), F.col("b")], "arc"), "arcs")  # a's arcs in a row
    ends = arcs.groupBy("a").agg(F.min("arc").alias("first"), F.max("arc").alias("last"))
    back = arcs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("arc").alias("back"))
    before = with_previous(arcs, "arc", ["a", "arc"], "prev_").filter(F.col("a") == F.col("prev_a"))
    inner = before.select(F.col("prev_arc").alias("turn"), F.col("arc").alias("next"))
    rooted = ends.join(roots.select(F.col("node").alias("a"), F.lit(True).alias("is_root")), "a", "left")
    wrap = rooted.select(F.col("last").alias("turn"), F.when(F.col("is_root"), None).otherwise(F.col("first")).alias("next"))
    # the arc into a node comes back along the same edge: what follows it is the turn after its reverse
    of_arc = arcs.join(back, ["a", "b"]).select("arc", "back", "a", "b")
    turns = inner.unionByName(wrap).withColumnRenamed("turn", "back")
    of_arc = materialize(of_arc, "arcs_back")
    links = of_arc.join(turns, "back").select(F.col("arc").alias("id"), "next")
    ranks = list_ranks(links, max_rows)

    ranked = of_arc.join(ranks.withColumnRenamed("id", "arc"), "arc")
    other = ranks.select(F.col("id").alias("back"), F.col("left").alias("back_left"))
    down = ranked.join(other, "back").filter(F.col("left") > F.col("back_left"))
    entered = materialize(down.select(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("left").cast("bigint").alias("left")), "entered")
    none = F.lit(None).cast("bigint")
    starts = roots.select("node", none.alias("parent"), none.alias("left"))
    top = _root_of(entered, roots)
    rows = entered.unionByName(starts).join(top, "node")
    order = [F.col("root"), F.col("left").desc_nulls_first()]
    return global_rank(rows, order, "place").select("root", "node", "parent", "place")


def _root_of(entered: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) by pointer doubling along parents."""
    now = entered.select("node", F.col("parent").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
    if metric(materialize(roots, "starts")) == 1:
        return now.select("node", F.lit(roots.first()["node"]).alias("root"))
    now = materialize(now, "roots", changed=F.sum(F.when(F.col("node") != F.col("root"), 1).otherwise(0)))
    changed = metric(now, "changed")
    while changed:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        moved = now.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved"))
        moved = materialize(moved, "roots", changed=F.sum(F.col("_moved").cast("int")))
        changed, now = metric(moved, "changed"), moved
    return now.select("node", "root")
