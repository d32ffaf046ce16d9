"""Node-table operators: numbering, metrics, edits, resolution.

All of them work on every tree of a table at once. Joins on a parent with very
many children rely on adaptive skew splitting; grouped results combine first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField

from cladeloom.operators.blocks import Walk, by_tree, column, has_plain_ids, links, placed, tree_numbers
from cladeloom.operators.ranking import groups_are_small, rank_in_group
from cladeloom.session import known_rows, materialize, metric, spread

KEY = ["tree_id", "node_id"]
PATH_END = (1 << 63) - 1


def in_tasks(
    nodes: DataFrame, work: Callable[[pa.Table], pa.Table], fields: list[StructField],
    by_joins: Callable[[DataFrame], DataFrame], max_rows: int | None,
) -> DataFrame:
    """``work`` on trees that fit a task, ``by_joins`` on the others; the last field is NULL in no other row."""
    if not has_plain_ids(nodes):
        return by_joins(nodes)
    left = fields[-1].name
    done = materialize(by_tree(nodes, work, fields, max_rows), "trees", large=F.count_if(F.col(left).isNull()))
    if not metric(done, "large"):
        return done
    large = materialize(done.filter(F.col(left).isNull()).select("tree_id").distinct(), "large")
    rest = by_joins(nodes.join(large, "tree_id", "left_semi")).select(*done.columns)
    return done.filter(F.col(left).isNotNull()).unionByName(rest)


def _fields(nodes: DataFrame, *dropped: str) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in nodes.schema.fields if f.name not in ("tree_id", *dropped)]


def _walk(block: pa.Table) -> Walk:
    names = block.column_names
    order = (column(block, "child_ord", -PATH_END),) if "child_ord" in names else ()
    return Walk(tree_numbers(block), links(block), order)


def _placed(block: pa.Table, numbers: bool) -> pa.Table:
    """Rows below a root with depth and dist and, if asked for, pre and post."""
    walk = _walk(block)
    null = block.column("length").is_null().to_numpy()
    dist = walk.down(block.column("length").cast(pa.float64()).fill_null(0.0).to_numpy())
    found = {"dist": pa.array(dist, mask=walk.unknown(null))}
    if numbers:
        found |= {k: pa.array(v) for k, v in zip(("pre", "post"), walk.numbers())}
    found["depth"] = pa.array(walk.depth.astype(np.int32))
    kept = pa.table({**{n: block.column(n) for n in block.column_names if n not in found}, **found})
    return kept if (walk.depth >= 0).all() else kept.filter(pa.array(walk.depth >= 0))


def root_distances(nodes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Adds ``depth`` (edges) and ``dist`` (length) from the root to every node.

    Trees that fit a task are walked there, after one shuffle; larger ones by joins.
    """
    nodes = placed(nodes.drop("depth", "dist", "path"), nodes)
    return in_tasks(
        nodes, lambda block: _placed(block, False),
        [*_fields(nodes), StructField("dist", DoubleType()), StructField("depth", IntegerType())],
        _root_distances_by_joins, max_rows)


def _root_distances_by_joins(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """Depth and dist in trees of any size.

    Pointer doubling: each round joins a node to the ancestor reached so far
    and doubles the distance covered, so a tree of height h needs log2(h)
    rounds. ``with_path`` also collects the child positions on the way down.
    """
    nodes = materialize(nodes, "nodes")
    rooted = F.col("parent_id").isNull()
    step = nodes.select(
        *KEY,
        F.col("parent_id").alias("_anc"),
        F.when(rooted, 0).otherwise(1).alias("_depth"),
        F.when(rooted, 0.0).otherwise(F.col("length")).alias("_dist"),
        F.when(rooted | F.lit(not with_path), F.array().cast("array<bigint>"))
        .otherwise(F.array("child_ord")).alias("_path"),
    )
    active = F.count("_anc")
    step = materialize(step, "walk", active=active)
    walking, done = step.filter("_anc is not null"), step.filter("_anc is null")
    while metric(step, "active"):  # rows that have arrived stay where they were written
        reach = done.unionByName(walking).select(
            "tree_id", F.col("node_id").alias("_anc"),
            F.col("_anc").alias("_anc2"), F.col("_depth").alias("_depth2"),
            F.col("_dist").alias("_dist2"), F.col("_path").alias("_path2"),
        )
        moved = walking.join(reach, ["tree_id", "_anc"]).select(
            *KEY,
            F.col("_anc2").alias("_anc"),
            (F.col("_depth") + F.col("_depth2")).alias("_depth"),
            (F.col("_dist2") + F.col("_dist")).alias("_dist"),
            F.concat("_path2", "_path").alias("_path"),
        )
        step = materialize(moved, "walk", active=active)
        walking, done = step.filter("_anc is not null"), done.unionByName(step.filter("_anc is null"))
    found = done.select(
        *KEY, F.col("_depth").alias("depth"), F.col("_dist").alias("dist"),
        *([F.col("_path").alias("path")] if with_path else []),
    )
    return nodes.drop("depth", "dist", "path").join(found, KEY)


def number_nodes(nodes: DataFrame, max_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Adds ``depth``, ``dist``, ``pre`` and ``post`` to a parent-pointer table, or returns only ``columns`` of it.

    Trees that fit a task are numbered there, after one shuffle. Larger ones should be
    shallow: their sort key is the path of child positions. Parsed trees carry their
    numbers already.
    """
    nodes = placed(nodes.drop("depth", "dist", "path", "pre", "post"), nodes)
    added = [StructField("dist", DoubleType()), StructField("pre", LongType()), StructField("post", LongType()),
             StructField("depth", IntegerType())]
    fields = [f for f in (*_fields(nodes), *added) if columns is None or f.name in (*columns, "depth")]
    return in_tasks(nodes, lambda block: _placed(block, True), fields, _number_by_joins, max_rows)


def _number_by_joins(nodes: DataFrame) -> DataFrame:
    nodes = materialize(nodes, "nodes")
    small = groups_are_small(nodes, "tree_id")
    walked = _root_distances_by_joins(nodes, with_path=True)
    ranked = rank_in_group(walked, "tree_id", [F.col("path")], "pre", small)
    after = F.concat(F.col("path"), F.array(F.lit(PATH_END)))
    return rank_in_group(
        ranked.withColumn("_after", after).drop("path"), "tree_id", [F.col("_after")], "post",
        small,
    ).drop("_after")


def subtree_size() -> Column:
    """Nodes at or below a node, from its numbers alone."""
    return F.col("post") - F.col("pre") + F.col("depth") + 1


def child_counts(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, n_children, n_leaf_children) of internal nodes."""
    return (
        nodes.filter("parent_id is not null")
        .groupBy("tree_id", F.col("parent_id").alias("node_id"))
        .agg(
            F.count("*").alias("n_children"),
            F.sum(F.col("is_leaf").cast("bigint")).alias("n_leaf_children"),
        )
    )


def tree_metrics(walked: DataFrame) -> DataFrame:
    """One row per tree from a table with ``depth`` and ``dist``.

    Leaves, nodes, total length, root-to-tip, height and leaf depths, whether
    binary, largest child count, rooted and unrooted cherries.
    """
    if known_rows(walked) is None:
        walked = materialize(walked.select(*KEY, "parent_id", "length", "is_leaf", "depth", "dist"), "walked")
    leaf = F.col("is_leaf")
    per_node = walked.groupBy("tree_id").agg(*_node_sums())
    kids = walked.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(
        F.count("*").alias("n_children"),
        F.sum(leaf.cast("bigint")).alias("n_leaf_children"),
        F.min("depth").alias("_level"),
    )
    # A root with one leaf child and one inner child that itself has exactly one
    # leaf child hides a further cherry across the root.
    one_leaf = F.col("n_leaf_children") == 1
    shape = kids.groupBy("tree_id").agg(
        F.min(F.when(F.col("n_children") == 2, 1).otherwise(0)).alias("_binary"),
        F.max("n_children").alias("max_children"),
        F.sum(
            F.when((F.col("n_children") == 2) & (F.col("n_leaf_children") == 2), 1).otherwise(0)
        ).alias("cherries"),
        (F.bool_or((F.col("_level") == 1) & (F.col("n_children") == 2) & one_leaf)
         & F.bool_or((F.col("_level") == 2) & one_leaf)).cast("int").alias("_hidden"),
    )
    return _metric_columns(per_node.join(shape, "tree_id", "left"))


def _node_sums() -> list[Column]:
    leaf = F.col("is_leaf")
    return [
        F.count("*").alias("n_nodes"),
        F.sum(leaf.cast("bigint")).alias("n_leaves"),
        F.sum("length").alias("total_length"),
        F.max(F.when(leaf, F.col("dist"))).alias("root_to_tip"),
        F.max(F.when(leaf, F.col("depth"))).cast("bigint").alias("height"),
        F.sum(F.when(leaf, F.col("depth"))).cast("bigint").alias("sum_height"),
    ]


def _metric_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        "tree_id", "n_nodes", "n_leaves", "total_length", "root_to_tip", "height", "sum_height",
        (F.col("sum_height") / F.col("n_leaves")).alias("avg_height"),
        (F.coalesce("_binary", F.lit(1)) == 1).alias("is_binary"),
        F.coalesce("max_children", F.lit(0)).cast("bigint").alias("max_children"),
        F.coalesce("cherries", F.lit(0)).cast("bigint").alias("cherries"),
        (F.coalesce("cherries", F.lit(0)) + F.coalesce("_hidden", F.lit(0))).cast("bigint")
        .alias("unrooted_cherries"),
    )


def edited_metrics(
    nodes: DataFrame, edit: Callable[[pa.Table], pa.Table] | None = None,
    by_joins: Callable[[DataFrame], DataFrame] | None = None, max_rows: int | None = None,
) -> DataFrame:
    """``tree_metrics`` of the trees ``edit`` makes of whole trees, walked and counted in the same pass.

    Trees too large for a task are edited by ``by_joins``.
    """
    fields = [StructField("length", DoubleType()), StructField("is_leaf", BooleanType()), StructField("dist", DoubleType()),
              StructField("n_children", LongType()), StructField("n_leaf_children", LongType()),
              StructField("depth", IntegerType())]

    def work(block: pa.Table) -> pa.Table:
        walked = _placed(block if edit is None else edit(block), False)
        parent, leaf = links(walked), walked.column("is_leaf").fill_null(False).to_numpy()
        below = parent >= 0
        return walked.append_column("n_children", pa.array(np.bincount(parent[below], minlength=len(parent)))).append_column(
            "n_leaf_children", pa.array(np.bincount(parent[below & leaf], minlength=len(parent))))

    def joined(rest: DataFrame) -> DataFrame:
        walked = materialize(_root_distances_by_joins(rest if by_joins is None else by_joins(rest)), "walked")
        return walked.join(child_counts(walked), KEY, "left").fillna(0, ["n_children", "n_leaf_children"])

    walked = in_tasks(nodes, work, fields, joined, max_rows)
    inner, one_leaf, depth = F.col("n_children") > 0, F.col("n_leaf_children") == 1, F.col("depth")
    two = F.col("n_children") == 2
    return _metric_columns(walked.groupBy("tree_id").agg(
        *_node_sums(),
        F.min(F.when(inner, two.cast("int"))).alias("_binary"),
        F.max("n_children").alias("max_children"),
        F.count_if(two & (F.col("n_leaf_children") == 2)).alias("cherries"),
        (F.bool_or((depth == 0) & two & one_leaf) & F.bool_or((depth == 1) & one_leaf)).cast("int").alias("_hidden"),
    ))


# --- lengths and heights ----------------------------------------------------


def scale_lengths(nodes: DataFrame, factor: float | Column) -> DataFrame:
    return nodes.withColumn("length", F.col("length") * factor)


def make_ultrametric(walked: DataFrame, target: Column | None = None) -> DataFrame:
    """Extend leaf edges so that every leaf is as far from the root as ``target``.

    Without a target the deepest leaf of each tree sets it.
    """
    tips = walked.filter("is_leaf").groupBy("tree_id").agg(F.max("dist").alias("_deepest"))
    goal = F.col("_deepest") if target is None else target
    return walked.join(tips, "tree_id").withColumn(
        "length",
        F.when(F.col("is_leaf"), F.col("length") + goal - F.col("dist")).otherwise(F.col("length")),
    ).drop("_deepest")


def node_times(walked: DataFrame) -> DataFrame:
    """``height`` = distance from the root."""
    return walked.withColumn("height", F.col("dist"))


def leftmost_heights(numbered: DataFrame) -> DataFrame:
    """``height`` = path length down to the leftmost leaf.

    That leaf comes first of its subtree in postorder, at number pre - depth.
    """
    tips = numbered.filter("is_leaf").select(
        "tree_id", F.col("post").alias("_first"), F.col("dist").alias("_tip")
    )
    return (
        numbered.withColumn("_first", F.col("pre") - F.col("depth"))
        .join(tips, ["tree_id", "_first"])
        .withColumn("height", F.col("_tip") - F.col("dist"))
        .drop("_first", "_tip")
    )


def node_heights(nodes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Adds ``edge_height``: edges from a node down to its furthest leaf.

    Trees that fit a task are walked there, after one shuffle; larger ones by joins.
    """
    def work(block: pa.Table) -> pa.Table:
        walk = _walk(block)
        high = block.append_column("edge_height", pa.array(walk.deepest() - walk.depth))
        return high if (walk.depth >= 0).all() else high.filter(pa.array(walk.depth >= 0))

    nodes = placed(nodes.drop("edge_height"), nodes)
    return in_tasks(nodes, work, [*_fields(nodes), StructField("edge_height", LongType())], _node_heights_by_joins, max_rows)


def _node_heights_by_joins(walked: DataFrame) -> DataFrame:
    """``edge_height`` in trees of any size.

    Each round hands the deepest node seen to the ancestor
    reached so far and doubles the reach, so height h takes log2(h) rounds.
    """
    walked = materialize(walked if "depth" in walked.columns else _root_distances_by_joins(walked), "walked")
    active = F.count("_anc")
    step = materialize(walked.select(
        *KEY, F.col("parent_id").alias("_anc"), F.col("depth").cast("bigint").alias("_deepest")
    ), "reach", active=active)
    while metric(step, "active"):
        below = step.filter("_anc is not null").groupBy(
            "tree_id", F.col("_anc").alias("node_id")
        ).agg(F.max("_deepest").alias("_below"))
        ahead = step.select("tree_id", F.col("node_id").alias("_anc"), F.col("_anc").alias("_anc2"))
        step = materialize(
            step.join(below, KEY, "left").join(ahead, ["tree_id", "_anc"], "left").select(
                *KEY, F.col("_anc2").alias("_anc"), F.greatest("_deepest", "_below").alias("_deepest"),
            ), "reach", active=active,
        )
    return walked.join(step.select(*KEY, "_deepest"), KEY).withColumn(
        "edge_height", F.col("_deepest") - F.col("depth")
    ).drop("_deepest")


def _with_parent(nodes: DataFrame, column: str, alias: str, how: str = "left") -> DataFrame:
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col(column).alias(alias))
    return nodes.join(parents, ["tree_id", "parent_id"], how)


def check_clock(with_heights: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """(tree_id, is_clock): every child path agrees with its parent's height."""
    gap = F.abs(F.col("_ph") - (F.col("height") + F.col("length")))
    return _with_parent(with_heights, "height", "_ph").groupBy("tree_id").agg(
        (F.coalesce(F.max(gap), F.lit(0.0)) <= epsilon).alias("is_clock")
    )


def lengths_from_heights(with_heights: DataFrame) -> DataFrame:
    """Edge length = parent height - own height (0 for a leaf); roots keep theirs."""
    own = F.when(F.col("is_leaf"), 0.0).otherwise(F.col("height"))
    return _with_parent(with_heights, "height", "_ph").withColumn(
        "length", F.coalesce(F.col("_ph") - own, F.col("length"))
    ).drop("_ph")


def branch_ids(numbered: DataFrame) -> DataFrame:
    """Internal non-root nodes get -n, -(n+1), ... in postorder, n = leaves of the tree."""
    numbered = materialize(numbered, "numbered")
    inner = numbered.filter("not is_leaf and parent_id is not null")
    leaves = numbered.filter("is_leaf").groupBy("tree_id").agg(F.count("*").alias("_n"))
    return (
        rank_in_group(inner, "tree_id", [F.col("post")], "_k", groups_are_small(inner, "tree_id"))
        .join(leaves, "tree_id")
        .withColumn("branch_id", -(F.col("_n") + F.col("_k")))
        .drop("_n", "_k")
    )


# --- edits ------------------------------------------------------------------


def check_topology(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent does not exist; empty for a sound table."""
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    return nodes.filter("parent_id is not null").join(parents, ["tree_id", "parent_id"], "left_anti")


def in_subtree(numbered: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows at or below the (tree_id, node_id) of ``tops``, at most one top per tree."""
    span = numbered.join(tops.select(*KEY), KEY, "left_semi").select(
        "tree_id", F.col("pre").alias("_lo"), (F.col("pre") + subtree_size() - 1).alias("_hi")
    )
    return numbered.join(span, "tree_id").filter("pre between _lo and _hi").drop("_lo", "_hi")


def erase_subtree(numbered: DataFrame, tops: DataFrame) -> DataFrame:
    return numbered.join(in_subtree(numbered, tops).select(*KEY), KEY, "left_anti")


def contract(nodes: DataFrame, victims: DataFrame) -> DataFrame:
    """Remove nodes; their children move to the parent's place, in reversed order.

    ``victims`` are (tree_id, node_id), no two of them parent and child.
    """
    gone = nodes.join(victims.select(*KEY), KEY, "left_semi").select(
        "tree_id", F.col("node_id").alias("parent_id"),
        F.col("parent_id").alias("_up"), F.col("child_ord").alias("_slot"),
    )
    kept = nodes.join(victims.select(*KEY), KEY, "left_anti")
    moved = (
        kept.join(gone, ["tree_id", "parent_id"], "left")
        .withColumn("_at", F.coalesce("_slot", "child_ord"))
        .withColumn("_sub", F.when(F.col("_slot").isNotNull(), -F.col("child_ord")).otherwise(0))
        .withColumn("parent_id", F.when(F.col("_slot").isNotNull(), F.col("_up"))
                    .otherwise(F.col("parent_id")))
        .withColumn("_family", F.struct("tree_id", "parent_id"))
    )
    moved = materialize(moved.drop("child_ord"), "moved")
    ranked = rank_in_group(
        moved, "_family", [F.col("_at"), F.col("_sub")], "child_ord",
        groups_are_small(moved, "_family"),
    )
    return ranked.select(*nodes.columns)


def insert_children(nodes: DataFrame, new: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Add leaf rows; a parent that was a leaf becomes internal."""
    rows = nodes.withColumn("_new", F.lit(False)).unionByName(
        new.select(*nodes.columns).withColumn("_new", F.lit(True)))

    def work(block: pa.Table) -> pa.Table:
        parent = links(block)
        below = parent[block.column("_new").to_numpy()]
        grown = np.zeros(len(parent), bool)
        grown[below[below >= 0]] = True
        leaf = pc.and_kleene(block.column("is_leaf"), pa.array(~grown))
        return block.set_column(block.column_names.index("is_leaf"), "is_leaf", leaf)

    fields = [*_fields(nodes, "node_id"), StructField("node_id", LongType())]
    return in_tasks(rows, work, fields, _insert_children_by_joins, max_rows).select(*nodes.columns)


def _insert_children_by_joins(rows: DataFrame) -> DataFrame:
    grown = rows.filter("_new").select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn(
        "_grown", F.lit(True)
    )
    return rows.join(grown, KEY, "left").withColumn(
        "is_leaf", F.col("is_leaf") & F.col("_grown").isNull()
    ).drop("_grown", "_new")


def graft(nodes: DataFrame, other: DataFrame, at: DataFrame, child_ord: int = -1) -> DataFrame:
    """Hang the trees of ``other`` below the (tree_id, node_id) of ``at``.

    Trees are matched on tree_id; ids of ``other`` are shifted past the host's.
    """
    top = nodes.groupBy("tree_id").agg((F.max("node_id") + 1).alias("_shift"))
    hosts = at.select("tree_id", F.col("node_id").alias("_host"))
    root = F.col("parent_id").isNull()
    low = other.groupBy("tree_id").agg(F.min("node_id").alias("_low"))
    hung = (
        other.join(top, "tree_id").join(low, "tree_id").join(hosts, "tree_id")
        .withColumn("_move", F.col("_shift") - F.col("_low"))
        .withColumn("node_id", F.col("node_id") + F.col("_move"))
        .withColumn("child_ord", F.when(root, F.lit(child_ord).cast("bigint"))
                    .otherwise(F.col("child_ord")))
        .withColumn("parent_id", F.when(root, F.col("_host"))
                    .otherwise(F.col("parent_id") + F.col("_move")))
    )
    columns = [c for c in nodes.columns if c in other.columns]
    hosts_inner = hosts.withColumnRenamed("_host", "node_id").withColumn("_grown", F.lit(True))
    host_rows = nodes.join(hosts_inner, KEY, "left").withColumn(
        "is_leaf", F.col("is_leaf") & F.col("_grown").isNull()
    )
    return host_rows.select(*columns).unionByName(hung.select(*columns))


def with_copies(block: pa.Table) -> pa.Table:
    """``graft`` of every tree of a block below each of its own rows that ``_host`` marks."""
    tree, node = tree_numbers(block), column(block, "node_id")
    host = block.column("_host").fill_null(False).to_numpy()
    start = np.flatnonzero(np.diff(tree, prepend=-1))
    size = np.diff(np.append(start, len(tree)))
    move = node[start + size - 1] + 1 - node[start]
    at = np.flatnonzero(host)
    many = size[tree[at]]
    row = np.repeat(start[tree[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())
    rooted = block.column("parent_id").is_null().to_numpy()
    parent, shift = column(block, "parent_id"), move[tree[row]]
    source = pa.array(np.concatenate([np.arange(len(tree)), row]))
    leaf = pc.and_kleene(block.column("is_leaf"), pa.array(~host))
    made = {
        "node_id": pa.array(np.concatenate([node, node[row] + shift])),
        "parent_id": pa.array(np.concatenate([parent, np.where(rooted[row], np.repeat(node[at], many), parent[row] + shift)]),
                              mask=np.concatenate([rooted, np.zeros(len(row), bool)])),
        "is_leaf": pa.concat_arrays([*_chunks(leaf), block.column("is_leaf").take(pa.array(row)).combine_chunks()]),
    }
    out = pa.table({c: made[c] if c in made else block.column(c).take(source) for c in block.column_names})
    return out.take(pa.array(np.lexsort((made["node_id"].to_numpy(), tree[source.to_numpy()]))))


def _chunks(values: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    return values.chunks if isinstance(values, pa.ChunkedArray) else [values]


def _reorder(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fresh ``child_ord`` in every family from its order by (_at, _sub)."""
    rows = materialize(
        rows.withColumn("_family", F.struct("tree_id", "parent_id")).drop("child_ord"), "families"
    )
    return rank_in_group(
        rows, "_family", [F.col("_at"), F.col("_sub")], "child_ord", groups_are_small(rows, "_family")
    ).select(*columns)


def _slots(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(tree_id, _after, parent_id, _slot) of the nodes in ``at``; a root has no sibling."""
    parent = F.when(F.col("parent_id").isNull(), F.raise_error(F.lit("a root cannot get a sibling")))
    return materialize(nodes.join(at.select(*KEY), KEY, "left_semi").select(
        "tree_id", F.col("node_id").alias("_after"),
        parent.otherwise(F.col("parent_id")).alias("parent_id"), F.col("child_ord").alias("_slot"),
    ), "slots")


def insert_siblings(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Add leaf rows, each right after the sibling that its column ``after`` names.

    ``new`` has at most one row per (tree_id, after); its parent_id and child_ord
    are set here.
    """
    slots = _slots(nodes, new.select("tree_id", F.col("after").alias("node_id")))
    placed = (
        new.drop("parent_id", "child_ord").withColumnRenamed("after", "_after")
        .join(slots, ["tree_id", "_after"], "left")
        .withColumns({"_at": F.coalesce("_slot", F.raise_error(F.lit("no such sibling"))),
                      "_sub": F.lit(1), "child_ord": F.col("_slot")})
    )
    old = nodes.withColumns({"_at": F.col("child_ord"), "_sub": F.lit(0)})
    return _reorder(old.unionByName(placed.select(*old.columns)), nodes.columns)


def graft_siblings(nodes: DataFrame, other: DataFrame, at: DataFrame) -> DataFrame:
    """Hang the trees of ``other`` right after the (tree_id, node_id) of ``at``, one per tree."""
    slots = _slots(nodes, at)
    hosts = slots.select("tree_id", F.col("parent_id").alias("node_id"))
    grown = graft(nodes.withColumn("_sub", F.lit(0)), other.withColumn("_sub", F.lit(1)), hosts)
    columns = [c for c in grown.columns if c != "_sub"]
    # Of the new rows only the grafted root lies below a host.
    placed = grown.join(slots.drop("_after"), ["tree_id", "parent_id"], "left").withColumn(
        "_at", F.when(F.col("_sub") == 1, F.coalesce("_slot", "child_ord")).otherwise(F.col("child_ord"))
    )
    return _reorder(placed.drop("_slot"), columns)


def reverse_children(nodes: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Mirror the child order of the given nodes, or of all."""
    if parents is None:
        return nodes.withColumn("child_ord", -F.col("child_ord"))
    chosen = parents.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_flip"))
    return nodes.join(chosen, ["tree_id", "parent_id"], "left").withColumn(
        "child_ord", F.when(F.col("_flip"), -F.col("child_ord")).otherwise(F.col("child_ord"))
    ).select(*nodes.columns)


def reroot(numbered: DataFrame, new_roots: DataFrame) -> DataFrame:
    """Make one (tree_id, node_id) per tree the root by turning its root path around.

    A turned node becomes the first child of its former child and takes over
    that edge's length; the new root gets length 0. Numbers are dropped.
    """
    target = numbered.join(new_roots.select(*KEY), KEY, "left_semi").select(
        "tree_id", F.col("pre").alias("_at"), F.col("node_id").alias("_new")
    )
    path = numbered.join(target, "tree_id").filter(
        F.col("_at").between(F.col("pre"), F.col("pre") + subtree_size() - 1)
    )
    turned = path.filter("parent_id is not null").select(
        "tree_id", F.col("parent_id").alias("node_id"),
        F.col("node_id").alias("_par"), F.col("length").alias("_len"),
    )
    first = F.lit(-PATH_END).cast("bigint")
    base = numbered.drop("pre", "post", "depth", "dist")
    out = base.join(turned, KEY, "left").join(target.select("tree_id", "_new"), "tree_id", "left")
    is_new = F.col("node_id") == F.col("_new")
    return out.select(
        "tree_id", "node_id",
        F.when(is_new, F.lit(None)).otherwise(F.coalesce("_par", "parent_id")).alias("parent_id"),
        F.when(is_new, F.lit(0).cast("bigint")).when(F.col("_par").isNotNull(), first)
        .otherwise(F.col("child_ord")).alias("child_ord"),
        "label",
        F.when(is_new, 0.0).otherwise(F.coalesce("_len", "length")).alias("length"),
        "is_leaf",
    )


def reroot_at(nodes: DataFrame, top: Column, max_rows: int | None = None) -> DataFrame:
    """(tree_id, node_id, parent_id, length) of ``reroot`` at the row of each tree where ``top`` holds.

    Trees that fit a task are turned there; larger ones by joins.
    """
    rows = placed(nodes.select(*KEY, "parent_id", "length", top.alias("_top")), nodes)
    fields = [StructField("parent_id", LongType()), StructField("length", DoubleType()), StructField("node_id", LongType())]

    def by_joins(rest: DataFrame) -> DataFrame:
        rest = materialize(rest.withColumns({
            "child_ord": F.col("node_id"), "label": F.lit(None).cast("string"), "is_leaf": F.lit(False)}), "rest")
        return reroot(_number_by_joins(rest.drop("_top")), rest.filter("_top"))

    return in_tasks(rows, _turned, fields, by_joins, max_rows).select(*KEY, "parent_id", "length")


def _turned(block: pa.Table) -> pa.Table:
    known = _walk(block).depth >= 0
    if not known.all():
        block = block.filter(pa.array(known))
    up, node = links(block), column(block, "node_id")
    null = block.column("length").is_null().to_numpy()
    length = block.column("length").cast(pa.float64()).fill_null(0.0).to_numpy()
    parent, edge, gone = column(block, "parent_id").copy(), length.copy(), null.copy()
    rooted = block.column("parent_id").is_null().to_numpy().copy()
    at = new = np.flatnonzero(block.column("_top").fill_null(False).to_numpy())
    while len(at):
        at = at[up[at] >= 0]
        above = up[at]
        parent[above], rooted[above] = node[at], False
        have = ~null[at]
        edge[above[have]], gone[above[have]] = length[at[have]], False
        at = above
    rooted[new], edge[new], gone[new] = True, 0.0, False
    return pa.table({"tree_id": block.column("tree_id"), "node_id": block.column("node_id"),
                     "parent_id": pa.array(parent, mask=rooted), "length": pa.array(edge, mask=gone)})


def same_trees(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Ordered equality of two numbered tables on position and ``columns``."""
    key = ["tree_id", "pre", "post", *columns]
    left, right = a.select(*key), b.select(*key)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def tree_digests(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """(tree_id, n_nodes, digest): equal for trees with the same nodes at the same places, of any size or shape.

    A node's places before and after its subtree fix the shape, so the digest is a
    sum without order over nodes, combined before the shuffle.
    """
    cell = [F.col(c) for c in ("pre", "post", *columns)]
    known = [F.col(c).isNull() for c in columns]  # null differs from every value
    return numbered.groupBy("tree_id").agg(
        F.count("*").alias("n_nodes"),
        F.concat(F.hex(F.bit_xor(F.xxhash64(*cell, *known))),
                 F.hex(F.bit_xor(F.xxhash64(F.lit(1), *cell, *known)))).alias("digest"))


def compare_trees(a: DataFrame, b: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(left_id, right_id, equal, first_difference) of pairs of numbered trees.

    Trees are compared by digest; only those that differ are joined, place by place, to
    find the first place in preorder where a node, its subtree's extent or its
    ``columns`` differ. A tree that is missing equals one that is missing.
    """
    left, right = (tree_digests(t, columns).select(F.col("tree_id").alias(f"{s}_id"), "n_nodes", F.col("digest").alias(s))
                   for t, s in ((a, "left"), (b, "right")))
    judged = pairs.select("left_id", "right_id").distinct().join(left.drop("n_nodes"), "left_id", "left").join(
        right.drop("n_nodes"), "right_id", "left")
    judged = materialize(judged.select("left_id", "right_id", F.col("left").eqNullSafe(F.col("right")).alias("equal")), "judged",
                         unequal=F.sum((~F.col("equal")).cast("bigint")))
    none = F.lit(None).cast("bigint")
    if not metric(judged, "unequal"):
        return judged.withColumn("first_difference", none)
    unequal = judged.filter("NOT equal").select("left_id", "right_id")
    cell = F.struct("post", *columns).alias("cell")
    each = [t.select(F.col("tree_id").alias(f"{s}_id"), "pre", cell).join(unequal, f"{s}_id").select(
        "left_id", "right_id", "pre", F.col("cell").alias(s)) for t, s in ((a, "left"), (b, "right"))]
    met = each[0].join(each[1], ["left_id", "right_id", "pre"], "full")
    first = met.filter(~F.col("left").eqNullSafe(F.col("right"))).groupBy("left_id", "right_id").agg(
        F.min("pre").alias("first_difference"))
    return judged.join(first, ["left_id", "right_id"], "left").select("left_id", "right_id", "equal", "first_difference")


# --- resolution -------------------------------------------------------------


def resolve(nodes: DataFrame, max_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Binary trees with the same likelihood.

    Unary nodes vanish with their own edge length. A node with k > 2 children
    wraps its first two under a new zero-length node until two are left, which
    yields k - 2 chained nodes. Needs ``pre``, ``post``, ``depth``, or numbers the nodes
    in the same pass; returns fresh ids (postorder numbers), numbers, depths and
    distances, or only ``columns`` of them. Trees that fit a
    task are resolved there, after one shuffle; larger ones by joins.
    """
    fields = [f for f in RESOLVED if columns is None or f.name in (*columns, "depth")]
    rows, work = resolving(nodes, columns)
    done = in_tasks(rows, work, fields, resolve_by_joins, max_rows)
    return done if columns is None else done.select("tree_id", *[c for c in columns if c != "tree_id"])


RESOLVED = [StructField("node_id", LongType()), StructField("parent_id", LongType()), StructField("child_ord", LongType()),
            StructField("label", StringType()), StructField("length", DoubleType()), StructField("is_leaf", BooleanType()),
            StructField("pre", LongType()), StructField("post", LongType()), StructField("dist", DoubleType()),
            StructField("depth", IntegerType())]


def resolving(nodes: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, Callable[[pa.Table], pa.Table]]:
    """The rows to resolve and the work on blocks of them."""
    fresh = not {"pre", "post", "depth"} <= set(nodes.columns)
    kept = ["tree_id", "node_id", "parent_id", "length", "is_leaf",
            *([c for c in ("child_ord",) if c in nodes.columns] if fresh else ["pre", "post", "depth"]),
            *(["label"] if columns is None or "label" in columns else [])]
    rows = placed(nodes.select(*kept), nodes)
    return rows, (lambda block: _resolved(_placed(block, True))) if fresh else _resolved


def resolve_by_joins(rows: DataFrame) -> DataFrame:
    """Trees of any size, numbered first if need be."""
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    return _resolve_by_joins(rows if "pre" in rows.columns else _number_by_joins(rows))


def _resolved(block: pa.Table) -> pa.Table:
    """Whole trees without unary nodes, children beyond two under chained wrappers."""
    parent, tree = links(block), tree_numbers(block)
    unary = np.bincount(parent[parent >= 0], minlength=len(parent)) == 1
    while True:  # pointers jump over chains of unary nodes, two at a time
        over = (parent >= 0) & unary[parent]
        if not over.any():
            break
        parent = np.where(over, parent[parent], parent)
    row = np.flatnonzero(~unary)
    at = np.cumsum(~unary) - 1
    parent = np.where(parent[row] >= 0, at[parent[row]], parent[row])
    n, tree = len(row), tree[row]

    kids = np.lexsort((column(block, "pre")[row], parent))
    kids = kids[np.searchsorted(parent[kids], 0):]
    count = np.bincount(parent[kids], minlength=n)
    place = np.zeros(n, np.int64)
    place[kids] = np.arange(len(kids)) - (np.cumsum(count) - count)[parent[kids]]
    inner = np.maximum(count - 2, 0)  # wrappers of a node, numbered from its first child up
    base = n + np.cumsum(inner) - inner - 1
    wrapped = np.zeros(n, bool)
    wrapped[kids] = place[kids] <= count[parent[kids]] - 2
    wrapped[kids] &= count[parent[kids]] > 2
    up = np.where(wrapped, base[parent] + np.maximum(place, 1), parent)
    owner = np.repeat(np.arange(n), inner)
    wrap = n + np.arange(len(owner))
    above = np.where(wrap < base[owner] + inner[owner], wrap + 1, owner)

    parent = np.concatenate([up, above])
    order = np.concatenate([np.minimum(place, 1), np.zeros(len(owner), np.int64)])
    tree = np.concatenate([tree, tree[owner]])
    source = pa.array(np.concatenate([row, np.zeros(len(owner), np.int64)]), mask=np.arange(len(parent)) >= n)
    length = block.column("length").cast(pa.float64()).take(source).combine_chunks()
    null = length.is_null().to_numpy(zero_copy_only=False)
    null[n:] = False
    walk = Walk(tree, parent, (order,))
    pre, post = walk.numbers()
    dist = pa.array(walk.down(length.fill_null(0.0).to_numpy()), mask=walk.unknown(null))
    out = pa.table({
        "tree_id": block.column("tree_id").take(pa.array(np.concatenate([row, row[owner]]))),
        "node_id": pa.array(post),
        "parent_id": pa.array(post[parent], mask=parent < 0),
        "child_ord": pa.array(order),
        **({"label": block.column("label").take(source)} if "label" in block.column_names else {}),
        "length": pa.array(np.where(np.arange(len(parent)) < n, length.fill_null(0.0).to_numpy(), 0.0), mask=null),
        "is_leaf": block.column("is_leaf").take(source).fill_null(False),
        "pre": pa.array(pre), "post": pa.array(post), "dist": dist,
        "depth": pa.array(walk.depth.astype(np.int32)),
    })
    chosen = np.lexsort((post, tree))
    return out.take(pa.array(chosen[walk.depth[chosen] >= 0]))


def _resolve_by_joins(numbered: DataFrame) -> DataFrame:
    """Trees of any size: ranks over all tasks and joins."""
    numbered = materialize(numbered, "numbered")
    kids = child_counts(numbered).select(*KEY, "n_children")
    nodes = numbered.select(
        *KEY, "parent_id", "label", "length", "is_leaf", "pre", "post", "depth"
    ).join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(_skip_unary(materialize(nodes, "counted")), "nodes")
    family = nodes.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(
        F.count("*").alias("_k"), F.min(_open_at()).alias("_first_open")
    )
    placed = rank_in_group(
        nodes.withColumn("_family", F.struct("tree_id", "parent_id")), "_family",
        [F.col("pre")], "_m",
    ).drop("_family")
    placed = placed.join(family, ["tree_id", "parent_id"], "left")

    # Wrapper j (1 .. k-2) joins wrapper j-1, or child 0, with child j.
    m, k, up = F.col("_m"), F.col("_k"), F.col("parent_id")

    def ref(node, j):
        return F.struct(node.cast("bigint").alias("node"), j.cast("bigint").alias("wrap"))

    inside = (k > 2) & (m <= k - 2)
    rows = placed.select(
        "tree_id",
        ref(F.col("node_id"), F.lit(0)).alias("ref"),
        F.when(up.isNotNull(), ref(up, F.when(inside, F.greatest(m, F.lit(1))).otherwise(0)))
        .alias("up"),
        F.when(up.isNull(), 0).otherwise(F.least(m, F.lit(1))).cast("bigint").alias("child_ord"),
        "label", "length", "is_leaf",
        _open_at().alias("o"), F.lit(0).cast("bigint").alias("o2"),
        _close_at().alias("c"), F.lit(0).cast("bigint").alias("c2"),
    )
    wrappers = placed.filter(inside & (m >= 1)).select(
        "tree_id",
        ref(up, m).alias("ref"),
        ref(up, F.when(m < k - 2, m + 1).otherwise(0)).alias("up"),
        F.lit(0).cast("bigint").alias("child_ord"),
        F.lit(None).cast("string").alias("label"),
        F.lit(0.0).alias("length"),
        F.lit(False).alias("is_leaf"),
        F.col("_first_open").alias("o"), (-m).alias("o2"),
        _close_at().alias("c"), F.lit(1).cast("bigint").alias("c2"),
    )
    return _root_distances_by_joins(_renumber(rows.unionByName(wrappers)))


def _open_at() -> Column:
    """Place of a node's opening bracket among all brackets of its tree."""
    return 2 * F.col("pre") - F.col("depth")


def _close_at() -> Column:
    return 2 * F.col("post") + F.col("depth") + 1


def _skip_unary(nodes: DataFrame) -> DataFrame:
    """Drop unary nodes; pointers jump over chains of them by doubling."""
    unary = nodes.filter("n_children = 1").select(
        "tree_id", F.col("node_id").alias("_u"), F.col("parent_id").alias("_next")
    )
    jump = materialize(unary, "unary")
    if not metric(jump):
        return nodes
    while True:
        hop = jump.select("tree_id", F.col("_u").alias("_next"), F.col("_next").alias("_far"),
                          F.lit(True).alias("_hit"))
        joined = jump.join(hop, ["tree_id", "_next"], "left")
        moved = materialize(
            joined.select(
                "tree_id", "_u",
                F.when(F.col("_hit"), F.col("_far")).otherwise(F.col("_next")).alias("_next"),
                F.coalesce("_hit", F.lit(False)).alias("_hit"),
            ), "unary", hits=F.count_if("_hit"),
        )
        jump = moved.drop("_hit")
        if not metric(moved, "hits"):
            break
    target = jump.select("tree_id", F.col("_u").alias("parent_id"), F.col("_next").alias("_to"),
                         F.lit(True).alias("_skip"))
    return nodes.filter("n_children != 1").join(target, ["tree_id", "parent_id"], "left").withColumn(
        "parent_id", F.when(F.col("_skip"), F.col("_to")).otherwise(F.col("parent_id"))
    ).drop("_to", "_skip")


def _renumber(rows: DataFrame) -> DataFrame:
    """Numbers from the order of brackets: (o, o2) opening and (c, c2) closing.

    A node's two brackets stand at 2*pre - depth and 2*post + depth + 1, so
    their ranks and the rank among openings give all three numbers.
    """
    rows = materialize(rows, "brackets")

    def bracket(at, sub, opens):
        return F.struct(at.alias("at"), sub.alias("sub"), F.lit(opens).alias("opens"))

    marks = rows.select(
        "tree_id", "ref",
        F.explode(F.array(bracket(F.col("o"), F.col("o2"), True),
                          bracket(F.col("c"), F.col("c2"), False))).alias("b"),
    ).select("tree_id", "ref", "b.*")
    placed = rank_in_group(marks, "tree_id", [F.col("at"), F.col("sub")], "_p")
    spans = placed.groupBy("tree_id", "ref").agg(
        F.min("_p").alias("_open"), F.max("_p").alias("_close")
    )
    numbered = rank_in_group(spans, "tree_id", [F.col("_open")], "pre")
    numbered = numbered.withColumn("depth", (2 * F.col("pre") - F.col("_open")).cast("int"))
    numbered = materialize(numbered.select(
        "tree_id", "ref", "depth", "pre",
        ((F.col("_close") - F.col("depth") - 1) / 2).cast("bigint").alias("post"),
    ), "numbers")
    ups = numbered.select("tree_id", F.col("ref").alias("up"), F.col("post").alias("parent_id"))
    return (
        rows.join(numbered, ["tree_id", "ref"])
        .join(ups, ["tree_id", "up"], "left")
        .select(
            "tree_id", F.col("post").alias("node_id"), "parent_id", "child_ord", "label",
            "length", "is_leaf", "depth", "pre", "post",
        )
    )
