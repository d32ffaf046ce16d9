"""Whole analyses: what a user runs on an alignment and a set of trees."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.operators import trees as O
from cladeloom.operators.likelihood import score_nodes
from cladeloom.operators.mcmc import MCMCOptions, run_mcmc
from cladeloom.operators.names import rename_leaves
from cladeloom.operators.patterns import compress, compress_patterns, path_length
from cladeloom.operators.simulate import scale_to_height, simulate_sequences, simulate_trees
from cladeloom.plans.decomposition import decompose, plan_heights, pruning_heights
from cladeloom.session import materialize
from cladeloom.sources.newick import to_newick


def tree_heights(nodes: DataFrame) -> DataFrame:
    """Per tree: taxa, lengths, and heights of the pruning and balanced plans."""
    resolved = materialize(O.resolve(nodes), "resolved")
    shape = O.tree_metrics(resolved).select(
        "tree_id", F.col("n_leaves").alias("ntax"), "root_to_tip", "total_length"
    )
    balanced = plan_heights(decompose(resolved)).withColumnsRenamed(
        {"height": "balanced_height", "avg_height": "balanced_avg_height"}
    )
    return (
        shape.join(pruning_heights(resolved), "tree_id", "left").join(balanced, "tree_id", "left")
        .withColumn("height_ratio", F.col("pruning_height") / F.col("balanced_height"))
        .withColumn("avg_height_ratio", F.col("pruning_avg_height") / F.col("balanced_avg_height"))
    )


def score_trees(
    patterns: DataFrame, nodes: DataFrame, taxa: DataFrame,
    model: SubstitutionModel | None = None,
) -> DataFrame:
    """Per tree: heights and the log-likelihood under both plans, with seconds.

    ``patterns`` are ordered patterns; their size and path averages come along.
    """
    model = model or JukesCantor()
    patterns = materialize(patterns.select("pattern_id", "pattern", "freq"), "patterns")
    resolved = materialize(O.resolve(nodes), "resolved")
    out = tree_heights(resolved)
    for layout in ("pruning", "balanced"):
        t0 = time.perf_counter()
        scored = materialize(score_nodes(patterns, resolved, taxa, model, layout), "scores")
        seconds = time.perf_counter() - t0
        out = out.join(
            scored.withColumnRenamed("loglik", f"loglik_{layout}"), "tree_id"
        ).withColumn(f"seconds_{layout}", F.lit(seconds))
    facts = path_length(patterns).drop("path_length")
    row = facts.first()
    constants = {f.name: F.lit(row[f.name]).cast(f.dataType) for f in facts.schema}
    return out.withColumns(constants).withColumn(
        "seconds_ratio", F.col("seconds_pruning") / F.col("seconds_balanced")
    )


def branch_length_mcmc(
    patterns: DataFrame, nodes: DataFrame, taxa: DataFrame, options: MCMCOptions,
    layouts: tuple[str, ...] = ("pruning", "balanced"),
) -> DataFrame:
    """Traces of the chosen layouts in one table, told apart by ``layout``."""
    resolved = materialize(O.resolve(nodes), "resolved")
    out = None
    for layout in layouts:
        trace = run_mcmc(patterns, decompose(resolved, layout), taxa, options).withColumn(
            "layout", F.lit(layout)
        )
        out = trace if out is None else out.unionByName(trace)
    return out


def run_simulation(
    spark: SparkSession, distributions, ntax: int, root_to_tips, nsites: int,
    replicates: int = 1, seed: int = 42, model: SubstitutionModel | None = None,
) -> dict[tuple[str, float], tuple[DataFrame, DataFrame]]:
    """Trees and leaf sequences per distribution and root-to-tip length.

    Returns {(distribution, root_to_tip): (nodes, cells)}; each replicate is a
    tree_id with a seed of its own.
    """
    out = {}
    for distribution in distributions:
        reps = spark.range(replicates).select(
            F.col("id").alias("tree_id"), F.lit(ntax).alias("n_taxa")
        )
        grown = materialize(simulate_trees(reps, distribution, seed), "grown")
        for height in root_to_tips:
            nodes = materialize(scale_to_height(grown, height), "simulated")
            sites = spark.range(replicates * nsites).select(
                F.floor(F.col("id") / nsites).cast("bigint").alias("tree_id"),
                (F.col("id") % nsites).alias("site"),
            )
            out[distribution, height] = nodes, simulate_sequences(nodes, sites, model, seed=seed)
    return out


def tidy_trees(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """(tree_id, newick) with every leaf renamed to the closest taxon of the alignment."""
    return to_newick(rename_leaves(nodes, taxa))


__all__ = [
    "branch_length_mcmc", "compress", "compress_patterns", "run_simulation", "score_trees",
    "tidy_trees", "tree_heights",
]
