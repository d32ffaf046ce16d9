"""States drawn along the supplier tree, and MCMC traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import trees as O
from cladeloom.operators.mcmc import MCMCOptions, run_mcmc
from cladeloom.operators.simulate import simulate_sequences
from cladeloom.plans.decomposition import decompose
from cladeloom.queries.base import Query
from cladeloom.queries.likelihood import T5, T7, event_patterns, line_patterns, one_tree
from cladeloom.queries.trees import SUPPLIER_TREE
from cladeloom.sources import tables as T


def _lattice_draw(tree, node, site):
    """A draw both engines compute alike; fit for checking, not for statistics."""
    mixed = (node * 7919 + site * 104729 + 12345) % 1000003
    return (mixed * 48271 % 1000003).cast("double") / 1000003


def _months(spark, sf):
    orders = T.read_table(spark, sf, "orders")
    return orders.select(
        F.lit(0).cast("bigint").alias("tree_id"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("site"),
    ).distinct()


def _supplier_nodes(spark, sf):
    return O.root_distances(T.supplier_tree(spark, sf))


def simulate_states(spark, sf):
    """One site per order month on the supplier tree."""
    states = simulate_sequences(
        _supplier_nodes(spark, sf), _months(spark, sf), draw=_lattice_draw
    )
    return states.select("label", "site", F.col("state").cast("bigint").alias("state"))


def mcmc_trace(layout, proposal="truncated"):
    def run(spark, sf):
        patterns, taxa = event_patterns(spark, sf)
        plan = decompose(one_tree(spark, T5), layout)
        options = MCMCOptions(width=0.05, iterations=200, chains=4, proposal=proposal)
        return run_mcmc(patterns, plan, taxa, options, lookahead=6).drop("seconds")

    return run


def mcmc_shared(spark, sf):
    """Line-number taxa; every pass runs over the partitions of all patterns."""
    return _line_trace(spark, sf, keep=False)


def mcmc_kept(spark, sf):
    """The same chains from component values kept in written tables."""
    return _line_trace(spark, sf, keep=True)


def _line_trace(spark, sf, keep):
    patterns, taxa = line_patterns(spark, sf)
    options = MCMCOptions(width=0.05, iterations=8, chains=2)
    return run_mcmc(patterns, decompose(one_tree(spark, T7)), taxa, options, keep=keep).drop("seconds")


def _level(name, upper, depth):
    same = "0.25 + 0.75 * e"
    other = "0.25 - 0.25 * e"
    p = [f"CASE WHEN s = {j} THEN {same} ELSE {other} END" for j in range(4)]
    return f"""{name} AS (
  SELECT node_id, label, is_leaf, site,
    CASE WHEN u < {p[0]} THEN 0 WHEN u < ({p[0]}) + ({p[1]}) THEN 1
         WHEN u < ({p[0]}) + ({p[1]}) + ({p[2]}) THEN 2 ELSE 3 END AS state
  FROM (SELECT n.node_id, n.label, n.is_leaf, site, state AS s, exp(-4.0 * n.length / 3) AS e, {_DRAW.format(node="n.node_id")} AS u
        FROM {upper} up JOIN nodes n ON n.parent_id = up.node_id WHERE n.depth = {depth}))"""


_DRAW = ("CAST(((({node} * 7919 + site * 104729 + 12345) % 1000003) * 48271) % 1000003 AS DOUBLE) "
         "/ 1000003")
_STATES_SQL = f"""
WITH {SUPPLIER_TREE},
sites AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS site FROM orders),
l0 AS (SELECT node_id, label, is_leaf, site, CAST(least(3, floor({_DRAW.format(node="node_id")} / 0.25)) AS INTEGER) AS state
       FROM nodes, sites WHERE depth = 0),
{_level("l1", "l0", 1)}, {_level("l2", "l1", 2)}, {_level("l3", "l2", 3)}
SELECT label, site, CAST(state AS BIGINT) AS state FROM l3"""

QUERIES = {
    "simulate_states_fk": Query(simulate_states, _STATES_SQL),
    "mcmc_trace_balanced": Query(mcmc_trace("balanced")),
    "mcmc_trace_pruning": Query(mcmc_trace("pruning")),
    "mcmc_trace_symmetric": Query(mcmc_trace("balanced", "symmetric")),
    "mcmc_trace_shared": Query(mcmc_shared),
    "mcmc_trace_kept": Query(mcmc_kept),
}
