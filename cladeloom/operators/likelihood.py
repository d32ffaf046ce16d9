"""Likelihood of patterns under trees: plans evaluated on Arrow batches.

Three ways, chosen by measured size:

* ``blocks``: all plans together are small, they travel to the patterns;
* ``grid``: many trees, each small; chunks of trees meet blocks of patterns;
* ``long``: a single tree is too large for a task; pruning by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import allows, codes_of_strings, state_matrix
from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.operators.layered import layered_loglik
from cladeloom.operators.pruning import pattern_cells, pruning_loglik
from cladeloom.plans import kernels
from cladeloom.session import materialize, metric, spread

MAX_BROADCAST_COMPONENTS = 400_000  # about 20 MB of plan arrays per executor
GRID_CHUNK_COMPONENTS = 200_000
GRID_BLOCK_CELLS = 32_000_000
MAX_PRUNING_ROUNDS = 40
LIVE_VALUES = 1 << 18  # doubles per array inside a kernel: stays in cache


class TreePlan:
    """One tree's plan as arrays, ready to score batches of patterns."""

    def __init__(self, rows: pd.DataFrame, model: SubstitutionModel):
        rows = rows.sort_values("comp_id")
        self.kind = rows["merge_type"].to_numpy(np.int8)
        self.left = rows["left"].fillna(-1).to_numpy(np.int64)
        self.right = rows["right"].fillna(-1).to_numpy(np.int64)
        self.parent = rows["parent"].fillna(-1).to_numpy(np.int64)
        self.taxon = rows["taxon_id"].fillna(-1).to_numpy(np.int64)
        self.lengths = rows["length"].fillna(0.0).to_numpy(float)
        self.model = model
        self.states = state_matrix()
        self.order = self._depth_first()
        self.set_lengths(self.lengths)

    def _depth_first(self) -> list[int]:
        """Merges so that a result is used soon after it is made."""
        order, stack = [], [int(np.flatnonzero(self.parent < 0)[0])]
        while stack:
            c = stack.pop()
            if self.kind[c]:
                order.append(c)
                stack += [int(self.left[c]), int(self.right[c])]
        return order[::-1]

    def set_lengths(self, lengths: np.ndarray) -> None:
        edges = np.flatnonzero(self.kind == 0)
        self.matrices = dict(zip(edges.tolist(), self.model.matrices(lengths[edges])))

    def edge(self, c: int, codes: np.ndarray, matrix: np.ndarray | None = None) -> np.ndarray:
        """Value of a single-edge component; ``codes`` is (taxa, patterns)."""
        matrix = self.matrices[c] if matrix is None else matrix
        if self.taxon[c] >= 0:
            return kernels.leaf_table(matrix, self.states)[:, codes[self.taxon[c]]]
        return matrix[:, :, None]

    def loglik(self, codes: np.ndarray) -> np.ndarray:
        """Log-likelihood of each row of (patterns, taxa) codes."""
        step = max(64, LIVE_VALUES // 16)
        return np.concatenate(
            [self._loglik(np.ascontiguousarray(codes[k : k + step].T))
             for k in range(0, len(codes), step)]
        ) if len(codes) else np.empty(0)

    def _loglik(self, codes: np.ndarray) -> np.ndarray:
        live, scales = {}, {}
        for c in self.order:
            parts, scale = [], 0
            for child in (int(self.left[c]), int(self.right[c])):
                if self.kind[child]:
                    parts.append(live.pop(child))
                    scale = scale + scales.pop(child)
                else:
                    parts.append(self.edge(child, codes))
            live[c], scales[c] = kernels.rescale(kernels.merge(self.kind[c], *parts), scale)
        return kernels.root_loglik(live[self.order[-1]], scales[self.order[-1]], self.model.pi)

    def loglik_shared(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """``loglik`` with every merge computed once per distinct pair of its parts.

        Also returns the number of merged columns, at most patterns times merges.
        """
        step = max(64, LIVE_VALUES // 16)
        parts = [self._loglik_shared(np.ascontiguousarray(codes[k : k + step].T))
                 for k in range(0, len(codes), step)]
        if not parts:
            return np.empty(0), 0
        return np.concatenate([p[0] for p in parts]), sum(p[1] for p in parts)

    def _loglik_shared(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        alike, merged = np.zeros(codes.shape[1], np.int64), 0
        live = {}

        def part(child):
            """Value and scale per distinct column, and each pattern's column."""
            if self.kind[child]:
                return live.pop(child)
            if self.taxon[child] >= 0:
                table = kernels.leaf_table(self.matrices[child], self.states)
                return table, np.zeros(table.shape[1], int), codes[self.taxon[child]]
            return self.matrices[child][:, :, None], np.zeros(1, int), alike

        for c in self.order:
            (a, a_scale, a_at), (b, b_scale, b_at) = part(int(self.left[c])), part(int(self.right[c]))
            width = b.shape[-1]
            pairs, at = np.unique(a_at.astype(np.int64) * width + b_at, return_inverse=True)
            left, right = np.divmod(pairs, width)
            value, scale = kernels.rescale(
                kernels.merge(self.kind[c], a[..., left], b[..., right]), a_scale[left] + b_scale[right]
            )
            live[c] = value, scale, at
            merged += len(pairs)
        value, scale, at = live[self.order[-1]]
        return kernels.root_loglik(value, scale, self.model.pi)[at], merged


def plan_with_taxa(plan: DataFrame, taxa: DataFrame) -> DataFrame:
    """Leaf edges get the taxon's position in the pattern; unknown leaves fail."""
    leaf = (F.col("merge_type") == 0) & F.col("is_clade")
    joined = plan.join(taxa.select(F.col("taxon").alias("label"), "taxon_id"), "label", "left")
    message = F.concat(F.lit("taxon "), F.coalesce("label", F.lit("?")),
                       F.lit(" in tree is not in the alignment"))
    return joined.withColumn(
        "taxon_id",
        F.when(leaf & F.col("taxon_id").isNull(), F.raise_error(message))
        .when(leaf, F.col("taxon_id")),
    )


PLAN_COLUMNS = ["tree_id", "comp_id", "left", "right", "parent", "merge_type", "taxon_id", "length"]


def _batches(pdf_iter, trees: dict[int, TreePlan], total: bool, reuse: bool):
    for pdf in pdf_iter:
        if pdf.empty:
            continue
        codes = codes_of_strings(pdf["pattern"].tolist())
        for tree_id, plan in trees.items():
            value = plan.loglik_shared(codes)[0] if reuse else plan.loglik(codes)
            if total:
                yield pd.DataFrame(
                    {"tree_id": [tree_id], "loglik": [float(value @ pdf["freq"].to_numpy(float))]}
                )
            else:
                yield pd.DataFrame(
                    {"tree_id": tree_id, "pattern_id": pdf["pattern_id"], "freq": pdf["freq"],
                     "loglik": value}
                )


def _schema(total: bool) -> str:
    if total:
        return "tree_id bigint, loglik double"
    return "tree_id bigint, pattern_id bigint, freq bigint, loglik double"


def _nothing(total: bool) -> pd.DataFrame:
    kinds = {"bigint": np.int64, "double": float}
    columns = dict(c.split() for c in _schema(total).split(", "))
    return pd.DataFrame({name: pd.Series([], dtype=kinds[k]) for name, k in columns.items()})


def load_plans(plan: DataFrame, model: SubstitutionModel) -> dict[int, TreePlan]:
    """Plans as arrays; only call below MAX_BROADCAST_COMPONENTS."""
    rows = plan.select(*PLAN_COLUMNS).toPandas()
    return {int(t): TreePlan(g, model) for t, g in rows.groupby("tree_id")}


def _blocks(patterns: DataFrame, plan: DataFrame, model, total: bool, reuse: bool) -> DataFrame:
    shared = patterns.sparkSession.sparkContext.broadcast(load_plans(plan, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batches(batches, shared.value, total, reuse)

    columns = patterns.select("pattern_id", "pattern", "freq")
    return spread(columns, "pattern_id").mapInPandas(run, _schema(total))


def _grid(patterns, plan, model, total, reuse, n_components, n_cells, chunk, block) -> DataFrame:
    """Chunks of trees x blocks of patterns, each pair one bounded task group."""
    chunks = max(1, -(-n_components // chunk))
    blocks = max(1, -(-n_cells // block))

    def every(n, name):
        return F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))).alias(name)

    left = patterns.select(
        "pattern_id", "pattern", "freq", every(chunks, "chunk"),
        F.pmod(F.xxhash64("pattern_id"), F.lit(int(blocks))).cast("int").alias("block"),
    )
    right = plan.select(
        *PLAN_COLUMNS, every(blocks, "block"),
        F.pmod(F.xxhash64("tree_id"), F.lit(int(chunks))).cast("int").alias("chunk"),
    )

    def run(pats: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        trees = {int(t): TreePlan(g, model) for t, g in rows.groupby("tree_id")}
        out = list(_batches([pats], trees, total, reuse))
        return pd.concat(out) if out else _nothing(total)

    left, right = (spread(side, "chunk", "block").groupBy("chunk", "block") for side in (left, right))
    return left.cogroup(right).applyInPandas(run, _schema(total))


def joined_loglik(patterns, nodes, taxa, model=None) -> DataFrame:
    """The ``long`` way: any tree shape, nothing but joins and grouped sums."""
    model = model or JukesCantor()
    named = nodes.withColumn("taxon", F.col("label"))
    scored = pruning_loglik(pattern_cells(patterns, taxa), named, model)
    return scored.join(patterns.select("pattern_id", "freq"), "pattern_id").select(
        "tree_id", "pattern_id", "freq", "loglik"
    )


def pattern_loglik(
    patterns: DataFrame,
    plan: DataFrame,
    taxa: DataFrame,
    model: SubstitutionModel | None = None,
    total: bool = False,
    strategy: str | None = None,
    chunk_components: int = GRID_CHUNK_COMPONENTS,
    block_cells: int = GRID_BLOCK_CELLS,
    reuse: bool = False,
) -> DataFrame:
    """Log-likelihood per (tree, pattern), or partial sums per tree with ``total``.

    ``patterns``: (pattern_id, pattern, freq); ``taxa``: (taxon_id, taxon);
    ``plan`` from ``decompose``. Taxa without a leaf in the tree are ignored.
    ``reuse`` computes equal sub-patterns of a batch once; it pays where subtrees
    see few of them. Plans together above the broadcast bound always go by grid.
    """
    model = model or JukesCantor()
    placed = materialize(plan_with_taxa(plan, taxa).select(*PLAN_COLUMNS), "plan")
    n_components = metric(placed)
    if strategy != "grid" and n_components <= MAX_BROADCAST_COMPONENTS:
        return _blocks(patterns, placed, model, total, reuse)
    n_cells = patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0
    return _grid(patterns, placed, model, total, reuse, n_components, n_cells, chunk_components, block_cells)


def tree_loglik(patterns, plan, taxa, model=None, **options) -> DataFrame:
    """(tree_id, loglik): frequency-weighted total per tree."""
    parts = pattern_loglik(patterns, plan, taxa, model, total=True, **options)
    return parts.groupBy("tree_id").agg(F.sum("loglik").alias("loglik"))


def _one_leaf_loglik(patterns, leaves, taxa, model) -> DataFrame:
    """(tree_id, loglik) of trees that are a single leaf: the share of its allowed states."""
    cells = pattern_cells(patterns, taxa).join(patterns.select("pattern_id", "freq"), "pattern_id")
    share = reduce(Column.__add__, [allows(F.col("symbol"), s) * p for s, p in zip("ACGT", model.pi)])
    return (
        cells.join(leaves.select("tree_id", F.col("label").alias("taxon")), "taxon")
        .groupBy("tree_id").agg(F.sum(F.col("freq") * F.ln(share)).alias("loglik"))
    )


def check_leaves(nodes: DataFrame, taxa: DataFrame) -> None:
    """Fail where a leaf has no row in the alignment."""
    known = taxa.select(F.col("taxon").alias("label"))
    unknown = nodes.filter("is_leaf").join(known, "label", "left_anti").select("label").first()
    if unknown is not None:
        raise ValueError(f"taxon {unknown['label']} in tree is not in the alignment")


def score_nodes(
    patterns: DataFrame, nodes: DataFrame, taxa: DataFrame,
    model: SubstitutionModel | None = None, layout: str = "balanced",
) -> DataFrame:
    """(tree_id, loglik) of trees of any shape and size, one row per tree.

    All trees are resolved and their leaves checked first. Each tree then goes its
    own way: those that fit a task are planned and scored on Arrow batches, larger
    ones by joins, level by level while they are shallow, else layer by layer of
    the balanced plan. A tree that is one leaf has the likelihood of its symbol,
    and patterns without data in a tree have likelihood 1 there.
    """
    from cladeloom.operators.trees import resolve
    from cladeloom.plans.decomposition import decompose

    model = model or JukesCantor()
    resolved = materialize(resolve(nodes), "resolved")
    check_leaves(resolved, taxa)
    shape = resolved.groupBy("tree_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))
    way = (
        F.when(F.col("n") == 1, "leaf")
        .when(2 * F.col("n") <= GRID_CHUNK_COMPONENTS, "tasks")
        .when(F.col("deepest") <= MAX_PRUNING_ROUNDS, "levels")
        .otherwise("layers")
    )
    shape = materialize(shape.select("tree_id", way.alias("way")), "ways")
    parts = []
    for name in [r["way"] for r in shape.select("way").distinct().orderBy("way").collect()]:
        chosen = resolved.join(shape.filter(F.col("way") == name), "tree_id", "left_semi")
        if name == "leaf":
            parts.append(_one_leaf_loglik(patterns, chosen, taxa, model))
            continue
        if name == "tasks":
            parts.append(tree_loglik(patterns, decompose(chosen, layout), taxa, model))
            continue
        if name == "levels":
            sites = joined_loglik(patterns, chosen, taxa, model)
        else:
            scored = layered_loglik(pattern_cells(patterns, taxa), decompose(chosen), model)
            sites = scored.join(patterns.select("pattern_id", "freq"), "pattern_id")
        parts.append(sites.groupBy("tree_id").agg(F.sum(F.col("freq") * F.col("loglik")).alias("loglik")))
    out = shape.select("tree_id")
    if not parts:
        return out.withColumn("loglik", F.lit(0.0))
    scores = reduce(DataFrame.unionByName, parts)
    return out.join(scores, "tree_id", "left").withColumn("loglik", F.coalesce("loglik", F.lit(0.0)))
