"""Random trees, one task each, and sequences evolved along trees by joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.session import materialize, metric, spread

DISTRIBUTIONS = ("uniform", "yule", "caterpillar", "beta_critical")

NODE_SCHEMA = (
    "tree_id bigint, node_id bigint, parent_id bigint, child_ord bigint, label string, "
    "length double, is_leaf boolean, depth int, pre bigint, post bigint, dist double"
)


class _Draft:
    """A tree under construction: child lists, edge lengths, leaf taxa."""

    def __init__(self):
        self.children, self.length, self.taxon = [], [], []

    def node(self, children=(), length=0.0, taxon=-1) -> int:
        self.children.append(list(children))
        self.length.append(length)
        self.taxon.append(taxon)
        return len(self.children) - 1


def _uniform(n: int, rng) -> tuple[_Draft, int]:
    """Each new leaf splits a random edge, the one above the root included."""
    t = _Draft()
    root = t.node(taxon=0)
    parent = {root: None}
    for taxon in range(1, n):
        below = int(rng.integers(len(t.children)))
        leaf = t.node(taxon=taxon)
        fork = t.node([below, leaf])
        above = parent[below]
        if above is None:
            root = fork
        else:
            t.children[above][t.children[above].index(below)] = fork
        parent.update({fork: above, below: fork, leaf: fork})
    _draw_lengths(t, root, lambda _: rng.exponential(1.0))
    return t, root


def _caterpillar(n: int, rng) -> tuple[_Draft, int]:
    t = _Draft()
    taxa = rng.permutation(n)
    spine = t.node(taxon=int(taxa[-1]))
    for taxon in taxa[-2::-1]:
        spine = t.node([t.node(taxon=int(taxon)), spine])
    _draw_lengths(t, spine, lambda _: rng.exponential(1.0))
    return t, spine


def _yule(n: int, rng, rate: float = 1.0) -> tuple[_Draft, int]:
    """Random pairs join; the wait with r lineages has mean rate / r."""
    t = _Draft()
    lineages = [(t.node(taxon=k), 0.0) for k in range(n)]
    now = 0.0
    while len(lineages) > 1:
        now += rng.exponential(rate / len(lineages))
        i, j = sorted(rng.choice(len(lineages), 2, replace=False).tolist())
        (b, tb), (a, ta) = lineages.pop(j), lineages.pop(i)
        t.length[a], t.length[b] = now - ta, now - tb
        lineages.append((t.node([a, b]), now))
    return t, lineages[0][0]


def _beta_critical(n: int, rng, ultrametric: bool = True) -> tuple[_Draft, int]:
    """A clade of m leaves splits into i and m-i with weight 1 / (i (m-i))."""
    t = _Draft()
    taxa = iter(rng.permutation(n).tolist())
    mean = np.concatenate([[1.0], 1.0 / np.cumsum(1.0 / np.arange(1, n + 1))])
    root = t.node()
    open_clades = [(root, n)]
    while open_clades:
        node, m = open_clades.pop()
        if m == 1:
            t.taxon[node] = next(taxa)
            continue
        i = np.arange(1, m)
        weight = 1.0 / (i * (m - i))
        cut = int(rng.choice(i, p=weight / weight.sum()))
        kids = [t.node(length=rng.exponential(mean[s])) for s in (cut, m - cut)]
        t.children[node] = kids
        open_clades += [(kids[1], m - cut), (kids[0], cut)]
    if ultrametric:
        _, dist = _walk(t, root)
        tips = [v for v in range(len(t.children)) if not t.children[v]]
        deepest = max(dist[v] for v in tips)
        for v in tips:
            if v != root:
                t.length[v] += deepest - dist[v]
    return t, root


def _draw_lengths(t: _Draft, root: int, draw) -> None:
    for v in range(len(t.length)):
        if v != root:
            t.length[v] = float(draw(v))


def _walk(t: _Draft, root: int):
    order, dist, stack = [], {root: 0.0}, [root]
    while stack:
        v = stack.pop()
        order.append(v)
        for c in t.children[v]:
            dist[c] = dist[v] + t.length[c]
        stack += reversed(t.children[v])
    return order, dist


_GROW = {
    "uniform": _uniform, "yule": _yule, "caterpillar": _caterpillar,
    "beta_critical": _beta_critical,
}


_NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
ROWS_PER_FRAME = 50_000


def _add_rows(rows: dict, tree_id: int, t: _Draft, root: int) -> None:
    """Append the node table of one tree; ids are postorder numbers."""
    order, dist = _walk(t, root)
    pre = {v: k for k, v in enumerate(order)}
    parent, slot, depth, size = {root: None}, {root: 0}, {root: 0}, {}
    for v in order:
        for k, c in enumerate(t.children[v]):
            parent[c], slot[c], depth[c] = v, k, depth[v] + 1
    for v in reversed(order):
        size[v] = 1 + sum(size[c] for c in t.children[v])
    post = {v: pre[v] - depth[v] + size[v] - 1 for v in order}
    rows["tree_id"] += [tree_id] * len(order)
    rows["node_id"] += [post[v] for v in order]
    rows["parent_id"] += [None if parent[v] is None else post[parent[v]] for v in order]
    rows["child_ord"] += [slot[v] for v in order]
    rows["label"] += [f"T{t.taxon[v]}" if t.taxon[v] >= 0 else None for v in order]
    rows["length"] += [t.length[v] for v in order]
    rows["is_leaf"] += [not t.children[v] for v in order]
    rows["depth"] += [depth[v] for v in order]
    rows["pre"] += [pre[v] for v in order]
    rows["post"] += [post[v] for v in order]
    rows["dist"] += [dist[v] for v in order]


def _frame(rows: dict) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["parent_id"] = pd.array(rows["parent_id"], "Int64")
    return out


def simulate_trees(replicates: DataFrame, distribution: str, seed: int = 42) -> DataFrame:
    """Node tables of random trees; ``replicates``: (tree_id, n_taxa).

    Every tree has its own generator, seeded by distribution and tree id, so a
    retried task draws the same tree.
    """
    grow, stream = _GROW[distribution], DISTRIBUTIONS.index(distribution)

    def run(batches):
        rows = {c: [] for c in _NODE_COLUMNS}
        for pdf in batches:
            for tree_id, n in zip(pdf["tree_id"], pdf["n_taxa"]):
                rng = np.random.Generator(np.random.PCG64([seed, stream, int(tree_id)]))
                _add_rows(rows, int(tree_id), *grow(int(n), rng))
                if len(rows["tree_id"]) >= ROWS_PER_FRAME:
                    yield _frame(rows)
                    rows = {c: [] for c in _NODE_COLUMNS}
        if rows["tree_id"]:
            yield _frame(rows)

    return spread(replicates.select("tree_id", "n_taxa"), "tree_id").mapInPandas(run, NODE_SCHEMA)


def scale_to_height(nodes: DataFrame, root_to_tip: float) -> DataFrame:
    """Scale each tree so that its deepest leaf lies ``root_to_tip`` below the root."""
    nodes = materialize(nodes, "nodes")
    deepest = nodes.filter("is_leaf").groupBy("tree_id").agg(F.max("dist").alias("_d"))
    factor = F.when(F.col("_d") > 0, F.lit(root_to_tip) / F.col("_d")).otherwise(1.0)
    return (
        nodes.join(deepest, "tree_id")
        .withColumn("length", F.col("length") * factor)
        .withColumn("dist", F.col("dist") * factor)
        .drop("_d")
    )


def hashed_uniform(seed: int) -> Callable[[Column, Column, Column], Column]:
    """Uniform draw per (tree, node, site) that a retried task repeats exactly."""

    def draw(tree: Column, node: Column, site: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, node, site), 11)
        return bits.cast("double") * F.lit(2.0**-53)

    return draw


def _pick(u: Column, weights: list[Column]) -> Column:
    """State whose cumulative weight first exceeds ``u``."""
    total, out = weights[0], None
    steps = []
    for w in weights[1:]:
        steps.append(total)
        total = total + w
    out = F.lit(3)
    for k in (2, 1, 0):
        out = F.when(u < steps[k], F.lit(k)).otherwise(out)
    return out


def simulate_sequences(
    nodes: DataFrame,
    sites: DataFrame,
    model: SubstitutionModel | None = None,
    draw: Callable[[Column, Column, Column], Column] | None = None,
    seed: int = 42,
) -> DataFrame:
    """(tree_id, label, site, state) of every leaf for each row (tree_id, site) of ``sites``.

    The root state follows the stationary frequencies, each child state the
    transition row of its parent. All sites of one tree level are one join.
    """
    model, draw = model or JukesCantor(), draw or hashed_uniform(seed)
    nodes = materialize(
        nodes.select("tree_id", "node_id", "parent_id", "label", "length", "is_leaf", "depth"),
        "nodes", deepest=F.max("depth"),
    )
    deepest = metric(nodes, "deepest")
    edges = nodes.select("tree_id", "node_id", "parent_id", "label", "length", "is_leaf", "depth")

    def uniform():
        return draw(F.col("tree_id"), F.col("node_id"), F.col("site"))

    roots = edges.filter("depth = 0")
    level = sites.select("tree_id", "site").join(roots, "tree_id").select(
        "tree_id", "node_id", "label", "is_leaf", "site",
        _pick(uniform(), [F.lit(p) for p in model.pi]).alias("state"),
    )
    tips = [level.filter("is_leaf")]
    t = F.col("length")
    for depth in range(1, deepest + 1):
        below = edges.filter(F.col("depth") == depth).withColumnRenamed("parent_id", "_up")
        upper = level.filter("not is_leaf").select(
            "tree_id", F.col("node_id").alias("_up"), "site", F.col("state").alias("_from")
        )
        rows = [[model.probability(i, j, t) for j in range(4)] for i in range(4)]
        weights = [
            F.when(F.col("_from") == 0, rows[0][j]).when(F.col("_from") == 1, rows[1][j])
            .when(F.col("_from") == 2, rows[2][j]).otherwise(rows[3][j])
            for j in range(4)
        ]
        level = upper.join(below, ["tree_id", "_up"]).select(
            "tree_id", "node_id", "label", "is_leaf", "site",
            *[w.alias(f"_w{j}") for j, w in enumerate(weights)],
        ).select(
            "tree_id", "node_id", "label", "is_leaf", "site",
            _pick(uniform(), [F.col(f"_w{j}") for j in range(4)]).alias("state"),
        )
        if deepest > 3:  # every level feeds the next and the output: compute it once
            level = materialize(level, "states")
        tips.append(level.filter("is_leaf"))
    out = tips[0]
    for tip in tips[1:]:
        out = out.unionByName(tip)
    return out.select("tree_id", "label", "site", "state")
