"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.session import materialize, metric

SMALL = 200_000


def components(links: DataFrame, small: int = SMALL) -> DataFrame | None:
    """(node, root) of every node in ``links`` (a, b); None where there are no links.

    In each round a node moves to the neighbour, or stays itself, whose hash of the
    round is least, and links are drawn between where their ends have moved to.
    Fresh hashes make the number of nodes shrink by a constant share whatever the
    shape of a component, so the rounds grow with the logarithm of its size. Sums
    per node are combined before they are shuffled, and every round is a written
    table. What is left once at most ``small`` links are counted is joined in one task.
    """
    edges = materialize(_tidy(links.select("a", "b")), "links")
    moves, step = [], 0
    while metric(edges) > small:
        step += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        moved = materialize(
            nearest.select(F.col("a").alias("node"), F.least("best", rank("a"))["v"].alias("to")), "moves"
        )
        moves.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        drawn = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = materialize(_tidy(drawn), "links")
    if metric(edges):
        moves.append(materialize(_joined(edges), "moves"))
    if not moves:
        return None
    labels = moves[0].select("node", F.col("to").alias("root"))
    for moved in moves[1:]:
        later = moved.select(F.col("node").alias("root"), "to")
        labels = labels.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(labels, "components")


def _joined(edges: DataFrame) -> DataFrame:
    """(node, to) of the ends of few links, by merging sets of nodes in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = {}

        def top(node):
            while above[node] != node:
                above[node] = node = above[above[node]]
            return node

        form = pa.int64()
        for batch in batches:
            form = batch.schema.field("a").type
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, form), pa.array(map(top, nodes), form)], names=["node", "to"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
