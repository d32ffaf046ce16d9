"""Pruning likelihood as joins and aggregations, for trees of any size and shape.

Every (node, pattern) pair is a row. One level of the tree is one grouped
product over children, so neither a tree nor a pattern is ever held whole.
Absent cells need no row: a missing base contributes the factor 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import allows
from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.session import materialize, metric

STATES = ["s0", "s1", "s2", "s3"]
NEG_INF = float("-inf")


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NEG_INF))


def _scaled(columns: list[Column]) -> tuple[Column, list[Column]]:
    """Maximum of four log values and the four values relative to it."""
    top = F.greatest(*columns)
    return top, [F.when(top == NEG_INF, F.lit(0.0)).otherwise(F.exp(c - top)) for c in columns]


def leaf_messages(cells: DataFrame, leaves: DataFrame, model: SubstitutionModel) -> DataFrame:
    """Log messages of present leaf cells to their parents.

    ``cells``: (pattern_id, taxon, symbol); ``leaves``: (tree_id, parent_id,
    taxon, length). Few distinct symbols meet each leaf, so messages are the
    model applied to 0/1 state sets.
    """
    joined = cells.join(leaves, "taxon")
    state = [allows(F.col("symbol"), b) for b in "ACGT"]
    up = model.message(state, F.col("length"))
    return joined.select(
        "tree_id", "parent_id", "pattern_id", *[_ln(u).alias(s) for u, s in zip(up, STATES)]
    )


def combine(messages: DataFrame) -> DataFrame:
    """Product over children: sum of log messages per (node, pattern).

    Sums combine before the shuffle, so a parent with very many children does
    not send them all to one task.
    """
    return messages.groupBy("tree_id", F.col("parent_id").alias("node_id"), "pattern_id").agg(
        *[F.sum(s).alias(s) for s in STATES]
    )


def lift(partials: DataFrame, edges: DataFrame, model: SubstitutionModel) -> DataFrame:
    """Send node partials through the edge above them: log messages to the parents."""
    top, scaled = _scaled([F.col(s) for s in STATES])
    rel = partials.select(
        "tree_id", "node_id", "pattern_id", top.alias("top"),
        *[c.alias(s) for c, s in zip(scaled, STATES)],
    ).join(edges, ["tree_id", "node_id"])
    up = model.message([F.col(s) for s in STATES], F.col("length"))
    return rel.select(
        "tree_id", "parent_id", "pattern_id",
        *[(_ln(u) + F.col("top")).alias(s) for u, s in zip(up, STATES)],
    )


def root_loglik(partials: DataFrame, model: SubstitutionModel) -> DataFrame:
    top, scaled = _scaled([F.col(s) for s in STATES])
    mean = sum((F.lit(p) * c for p, c in zip(model.pi[1:], scaled[1:])),
               F.lit(model.pi[0]) * scaled[0])
    return partials.select("tree_id", "pattern_id", (_ln(mean) + top).alias("loglik"))


def pruning_loglik(
    cells: DataFrame,
    nodes: DataFrame,
    model: SubstitutionModel | None = None,
    materialize_every: int = 8,
) -> DataFrame:
    """(tree_id, pattern_id, loglik) for cells (pattern_id, taxon, symbol).

    ``nodes`` needs ``depth`` (0 at the root) and, on leaves, ``taxon``. Leaf
    taxa without cells and cells of taxa outside the tree add nothing.
    """
    model = model or JukesCantor()
    nodes = materialize(nodes, "nodes", deepest=F.max("depth"))
    max_depth = metric(nodes, "deepest") or 0
    leaves = nodes.filter("is_leaf and parent_id is not null").select(
        "tree_id", "parent_id", "taxon", "length", "depth"
    )
    inner = nodes.filter("not is_leaf").select(
        "tree_id", "node_id", "parent_id", "length", "depth"
    )
    waiting = None
    for depth in range(max_depth, 0, -1):
        parts = [leaf_messages(cells, leaves.filter(F.col("depth") == depth).drop("depth"), model)]
        if waiting is not None:
            edges = inner.filter(F.col("depth") == depth).drop("depth")
            parts.append(lift(waiting, edges, model))
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        waiting = combine(merged)
        if (max_depth - depth + 1) % materialize_every == 0 and depth > 1:
            waiting = materialize(waiting, "partials")
    return root_loglik(waiting, model)


def pattern_cells(ordered: DataFrame, taxa: DataFrame) -> DataFrame:
    """(pattern_id, taxon, symbol) of pattern strings; ``taxa`` maps taxon_id to taxon.

    Missing cells are dropped, except in a pattern that has nothing else.
    """
    long = ordered.select(
        "pattern_id",
        F.col("pattern").rlike("[^e]").alias("_some"),
        F.posexplode(F.split("pattern", "")).alias("taxon_id", "symbol"),
    ).filter("symbol != 'e' or not _some")
    return long.join(taxa, "taxon_id").select("pattern_id", "taxon", "symbol")
