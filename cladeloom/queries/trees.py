"""Tree operators on the supplier hierarchy and on the forest of customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeloom.operators import trees as O
from cladeloom.operators.blocks import placed
from cladeloom.plans import decomposition as D
from cladeloom.queries.base import Query, rounded, sql_round
from cladeloom.session import materialize
from cladeloom.sources import tables as T


def _numbered(spark, sf):
    return O.number_nodes(T.supplier_tree(spark, sf))


def _walked_forest(spark, sf):
    return O.root_distances(T.customer_forest(spark, sf))


def _resolved_forest(spark, sf):
    return O.resolve(T.customer_forest(spark, sf))


def tree_nodes(spark, sf):
    return _numbered(spark, sf).select(
        "node_id", "parent_id", "label", F.col("depth").cast("bigint").alias("depth"),
        rounded("dist").alias("dist"), "pre", "post",
        O.subtree_size().cast("bigint").alias("subtree_size"),
    )


_METRICS = ["n_nodes", "n_leaves", "height", "sum_height", "is_binary", "max_children",
            "cherries", "unrooted_cherries"]


def _metric_rows(metrics):
    return metrics.select(
        "tree_id", *_METRICS, rounded("total_length").alias("total_length"),
        rounded("root_to_tip").alias("root_to_tip"), rounded("avg_height").alias("avg_height"),
    )


def tree_metrics_fk(spark, sf):
    return _metric_rows(O.tree_metrics(O.root_distances(T.supplier_tree(spark, sf))))


def tree_metrics_forest(spark, sf):
    return _metric_rows(O.tree_metrics(_walked_forest(spark, sf)))


def tree_scale(spark, sf):
    """Every tree scaled to a root-to-tip length of 1."""
    walked = _walked_forest(spark, sf)
    tip = walked.filter("is_leaf").groupBy("tree_id").agg(F.max("dist").alias("_tip"))
    scaled = O.scale_lengths(walked.join(tip, "tree_id"), 1 / F.col("_tip"))
    return scaled.groupBy("tree_id").agg(rounded(F.sum("length")).alias("total_length"))


def tree_ultrametric(spark, sf):
    walked = O.root_distances(T.supplier_tree(spark, sf))
    return O.make_ultrametric(walked).select("node_id", rounded("length").alias("length"))


def branch_ids(spark, sf):
    return O.branch_ids(_numbered(spark, sf)).select("node_id", "branch_id")


def leftmost_heights(spark, sf):
    return O.leftmost_heights(_numbered(spark, sf)).select(
        "node_id", rounded("height").alias("height")
    )


def clock_check(spark, sf):
    """Before and after the trees are made ultrametric."""
    numbered = O.number_nodes(T.customer_forest(spark, sf))
    before = O.check_clock(O.leftmost_heights(numbered))
    even = O.make_ultrametric(numbered).withColumn(
        "dist", F.when(F.col("is_leaf"), F.lit(1.0)).otherwise(F.col("dist"))
    )
    deepest = numbered.filter("is_leaf").groupBy("tree_id").agg(F.max("dist").alias("_d"))
    even = even.join(deepest, "tree_id").withColumn(
        "dist", F.when(F.col("is_leaf"), F.col("_d")).otherwise(F.col("dist"))
    )
    after = O.check_clock(O.leftmost_heights(even)).withColumnRenamed("is_clock", "is_clock_after")
    return before.join(after, "tree_id")


def lengths_from_heights(spark, sf):
    """Heights counted down from the deepest leaf of the supplier tree."""
    walked = O.root_distances(T.supplier_tree(spark, sf))
    deepest = walked.groupBy("tree_id").agg(F.max("dist").alias("_d"))
    high = walked.join(deepest, "tree_id").withColumn("height", F.col("_d") - F.col("dist"))
    return O.lengths_from_heights(high).select("node_id", rounded("length").alias("length"))


def node_times(spark, sf):
    return O.node_times(_walked_forest(spark, sf)).groupBy("tree_id", "is_leaf").agg(
        F.count("*").alias("n"), rounded(F.sum("height")).alias("sum_times")
    )


def child_counts(spark, sf):
    return O.child_counts(T.customer_forest(spark, sf))


def contract_edges(spark, sf):
    """All orders contracted: lines hang directly below their customer."""
    forest = T.customer_forest(spark, sf)
    flat = O.contract(forest, forest.filter("parent_id is not null and not is_leaf"))
    return flat.select("tree_id", "node_id", "parent_id", "child_ord", rounded("length").alias("length"))


def erase_subtree(spark, sf):
    """The supplier tree without its first region."""
    numbered = materialize(_numbered(spark, sf), "numbered")
    first = numbered.filter("depth = 1").groupBy("tree_id").agg(F.min("node_id").alias("node_id"))
    return O.erase_subtree(numbered, first).select("node_id", "parent_id", "label")


def subtree_scan(spark, sf):
    """Everything below the first region, in preorder."""
    numbered = materialize(_numbered(spark, sf), "numbered")
    first = numbered.filter("depth = 1").groupBy("tree_id").agg(F.min("node_id").alias("node_id"))
    return O.in_subtree(numbered, first).select("node_id", "label", "pre")


def graft_trees(spark, sf):
    """A copy of every customer's tree grafted below its own root."""
    forest = T.customer_forest(spark, sf)
    rows = placed(forest.select("tree_id", "node_id", "parent_id", "length", "is_leaf", F.col("parent_id").isNull().alias("_host")), forest)

    def by_joins(large):
        trees = large.withColumn("child_ord", F.col("node_id")).drop("_host")
        return O.graft(trees, trees, large.filter("_host"))

    return _metric_rows(O.edited_metrics(rows, O.with_copies, by_joins))


def insert_children(spark, sf):
    """Two new leaves below every line of the forest."""
    forest = T.customer_forest(spark, sf)
    lines = forest.filter("is_leaf")
    new = None
    for k in (1, 2):
        part = lines.select(
            "tree_id", (-F.col("node_id") * 2 - 10 - k).alias("node_id"),
            F.col("node_id").alias("parent_id"), F.lit(k).cast("bigint").alias("child_ord"),
            F.concat("label", F.lit(f"_{k}")).alias("label"), F.lit(0.01 * k).alias("length"),
            F.lit(True).alias("is_leaf"),
        )
        new = part if new is None else new.unionByName(part)
    return _metric_rows(O.tree_metrics(O.root_distances(O.insert_children(forest, new))))


def insert_siblings(spark, sf):
    """A new leaf right after every nation."""
    tree = T.supplier_tree(spark, sf)
    nations = tree.filter(F.col("node_id").between(2 * T.LEVEL, 3 * T.LEVEL - 1))
    new = nations.select(
        "tree_id", F.col("node_id").alias("after"), (-F.col("node_id")).alias("node_id"),
        F.concat("label", F.lit("+")).alias("label"), F.lit(0.01).alias("length"),
        F.lit(True).alias("is_leaf"),
    )
    return O.number_nodes(O.insert_siblings(tree, new)).select("label", "pre")


def graft_siblings(spark, sf):
    """A copy of the whole tree grafted right after its first region."""
    tree = T.supplier_tree(spark, sf)
    first = tree.filter("parent_id = 0").groupBy("tree_id").agg(F.min("node_id").alias("node_id"))
    return O.number_nodes(O.graft_siblings(tree, tree, first)).select(
        "label", rounded("length").alias("length"), "pre"
    )


def node_heights(spark, sf):
    """Edges from every node of the forest down to its furthest leaf."""
    return O.node_heights(T.customer_forest(spark, sf)).select("tree_id", "node_id", "edge_height")


def reroot_forest(spark, sf):
    """Each customer's tree rooted at its lowest order."""
    forest = T.customer_forest(spark, sf)
    order = F.when(F.col("parent_id").isNotNull() & ~F.col("is_leaf"), F.col("node_id"))
    lowest = F.min(order).over(Window.partitionBy("tree_id"))
    return O.reroot_at(placed(forest.withColumn("_first", lowest), forest), F.col("node_id") == F.col("_first")).select(
        "tree_id", "node_id", "parent_id", rounded("length").alias("length")
    )


def reverse_children(spark, sf):
    """Preorder of the supplier tree with all child lists reversed."""
    mirrored = O.reverse_children(T.supplier_tree(spark, sf))
    return O.number_nodes(mirrored).select("node_id", "label", "pre", "post")


def topology_check(spark, sf):
    """Forest rows that lost their parent when orders of one status are dropped."""
    forest = T.customer_forest(spark, sf)
    shipped = T.read_table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") * 8).alias("node_id"), F.col("o_custkey").alias("tree_id")
    )
    broken = forest.join(shipped, ["tree_id", "node_id"], "left_anti")
    return O.check_topology(broken).select("tree_id", "node_id", "parent_id")


def tree_equality(spark, sf):
    """Nodes at the same place with the same label in the tree and its mirror image."""
    numbered = materialize(_numbered(spark, sf), "numbered")
    mirror = materialize(
        O.number_nodes(O.reverse_children(T.supplier_tree(spark, sf))), "mirror"
    )
    key = ["tree_id", "pre", "post", "label"]
    same = numbered.select(*key).intersectAll(mirror.select(*key))
    return same.select("pre", "post", "label")


def tree_pairs_equal(spark, sf):
    """Trees of customers against copies in which some tips have other lengths."""
    columns = ["tree_id", "node_id", "length", "is_leaf", "pre", "post"]
    trees = materialize(O.number_nodes(T.customer_forest(spark, sf), columns=columns), "numbered")
    moved = (F.col("is_leaf") & (F.col("node_id") % 37 == 0)).cast("double")
    copies = trees.withColumn("length", F.col("length") + moved)
    pairs = trees.select(F.col("tree_id").alias("left_id"), F.col("tree_id").alias("right_id"))
    return O.compare_trees(trees, copies, pairs, ["node_id", "length"])


def resolve_fk(spark, sf):
    resolved = O.resolve(_numbered(spark, sf))
    return _metric_rows(O.tree_metrics(resolved.withColumn("dist", F.lit(0.0)))).drop(
        "root_to_tip", "cherries", "unrooted_cherries"
    )


def resolve_forest(spark, sf):
    return _metric_rows(O.tree_metrics(_resolved_forest(spark, sf))).drop("cherries", "unrooted_cherries")


def pruning_heights(spark, sf):
    resolved = O.resolve(T.customer_forest(spark, sf), columns=["tree_id", "parent_id", "is_leaf", "depth"])
    return D.pruning_heights(resolved).select(
        "tree_id", "pruning_height", rounded("pruning_avg_height").alias("pruning_avg_height")
    )


def decomp_table(spark, sf):
    return D.resolve_and_plan(T.customer_forest(spark, sf))


def decomp_heights(spark, sf):
    """Heights of both layouts and their ratios, per tree."""
    plan = D.resolve_and_plan(T.customer_forest(spark, sf), columns=["tree_id", "merge_type", "is_clade", "depth", "node_depth"])
    return D.layout_heights(plan).select(
        "tree_id", "height", "avg_height", "pruning_height", "pruning_avg_height",
        (F.col("pruning_height") / F.col("height")).alias("height_ratio"),
        (F.col("pruning_avg_height") / F.col("avg_height")).alias("avg_height_ratio"),
    )


def decomp_sizes(spark, sf):
    """Components of a plan by merge type group: edges and merges follow from the leaves."""
    plan = D.resolve_and_plan(T.customer_forest(spark, sf), columns=["tree_id", "merge_type", "length"])
    return plan.groupBy("tree_id").agg(
        F.count("*").alias("n_components"),
        F.sum((F.col("merge_type") == 0).cast("bigint")).alias("n_edges"),
        F.sum((F.col("merge_type") > 0).cast("bigint")).alias("n_merges"),
        rounded(F.sum("length")).alias("total_length"),
    )


def pruning_table(spark, sf):
    plan = D.resolve_and_plan(T.customer_forest(spark, sf), "pruning", ["tree_id", "merge_type", "depth"])
    return D.plan_heights(plan).select(
        "tree_id", F.col("height").alias("pruning_height"),
        rounded("avg_height").alias("pruning_avg_height"),
    )


# --- SQL --------------------------------------------------------------------

_LEVEL = T.LEVEL
SUPPLIER_TREE = f"""
sup AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier),
nat AS (SELECT n.* FROM nation n WHERE n_nationkey IN (SELECT s_nationkey FROM sup)),
reg AS (SELECT r.* FROM region r WHERE r_regionkey IN (SELECT n_regionkey FROM nat)),
nodes AS (
  SELECT CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS label,
         CAST(0 AS DOUBLE) AS length, FALSE AS is_leaf, 0 AS depth,
         CAST(0 AS BIGINT) AS k1, CAST(-1 AS BIGINT) AS k2, CAST(-1 AS BIGINT) AS k3
  UNION ALL SELECT {_LEVEL} + r_regionkey, 0, r_name, CAST(1 + r_regionkey % 7 AS DOUBLE) / 100,
         FALSE, 1, r_regionkey, -1, -1 FROM reg
  UNION ALL SELECT 2 * {_LEVEL} + n_nationkey, {_LEVEL} + n_regionkey, n_name,
         CAST(1 + n_nationkey % 7 AS DOUBLE) / 100, FALSE, 2, n_regionkey, n_nationkey, -1 FROM nat
  UNION ALL SELECT 3 * {_LEVEL} + s_suppkey, 2 * {_LEVEL} + s_nationkey, s_name,
         CAST(1 + s_suppkey % 7 AS DOUBLE) / 100, TRUE, 3, n_regionkey, n_nationkey, s_suppkey
         FROM sup JOIN nat ON s_nationkey = n_nationkey),
RECURSIVE_walk AS (
  SELECT n.*, n.length + coalesce(p.length, 0) + coalesce(g.length, 0) AS dist
  FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.node_id LEFT JOIN nodes g ON p.parent_id = g.node_id),
big AS (SELECT CAST(9223372036854775807 AS BIGINT) AS b),
walk AS (
  SELECT w.*, row_number() OVER (ORDER BY CASE WHEN depth = 0 THEN -1 ELSE k1 END, k2, k3) - 1 AS pre,
    row_number() OVER (ORDER BY CASE WHEN depth = 0 THEN b ELSE k1 END,
                                CASE WHEN depth <= 1 THEN b ELSE k2 END,
                                CASE WHEN depth <= 2 THEN b ELSE k3 END) - 1 AS post
  FROM RECURSIVE_walk w, big)
""".replace("RECURSIVE_walk", "dists")

FOREST = """
lines AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
leaf AS (SELECT o_custkey, o_orderkey, l_linenumber FROM orders JOIN lines ON o_orderkey = l_orderkey),
nodes AS (
  SELECT DISTINCT o_custkey AS tree_id, CAST(-1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id,
         CAST(0 AS DOUBLE) AS length, FALSE AS is_leaf, 0 AS depth, CAST(0 AS DOUBLE) AS dist FROM leaf
  UNION ALL SELECT DISTINCT o_custkey, o_orderkey * 8, -1, CAST(1 + o_orderkey % 7 AS DOUBLE) / 100,
         FALSE, 1, CAST(1 + o_orderkey % 7 AS DOUBLE) / 100 FROM leaf
  UNION ALL SELECT o_custkey, o_orderkey * 8 + l_linenumber, o_orderkey * 8,
         CAST(1 + (o_orderkey + l_linenumber) % 5 AS DOUBLE) / 100, TRUE, 2,
         CAST(1 + o_orderkey % 7 AS DOUBLE) / 100
           + CAST(1 + (o_orderkey + l_linenumber) % 5 AS DOUBLE) / 100 FROM leaf)
"""


def _metrics_sql(ctes, tree_id="tree_id"):
    """Metrics of ``nodes`` (tree_id, node_id, parent_id, length, is_leaf, depth, dist)."""
    return f"""
WITH {ctes},
t AS (SELECT {tree_id} AS tree_id, node_id, parent_id, length, is_leaf, depth, dist FROM walked),
kids AS (SELECT tree_id, parent_id AS node_id, count(*) AS n,
                count(*) FILTER (WHERE is_leaf) AS nl FROM t WHERE parent_id IS NOT NULL GROUP BY ALL),
a AS (SELECT tree_id, count(*) AS n_nodes, count(*) FILTER (WHERE is_leaf) AS n_leaves,
        sum(length) AS total_length, max(dist) FILTER (WHERE is_leaf) AS root_to_tip,
        CAST(max(depth) FILTER (WHERE is_leaf) AS BIGINT) AS height,
        CAST(sum(depth) FILTER (WHERE is_leaf) AS BIGINT) AS sum_height FROM t GROUP BY tree_id),
s AS (SELECT tree_id, bool_and(n = 2) AS is_binary, max(n) AS max_children,
        count(*) FILTER (WHERE n = 2 AND nl = 2) AS cherries FROM kids GROUP BY tree_id),
h AS (SELECT r.tree_id FROM t r JOIN kids rk USING (tree_id, node_id)
      JOIN t c ON c.tree_id = r.tree_id AND c.parent_id = r.node_id AND NOT c.is_leaf
      JOIN kids ck ON ck.tree_id = c.tree_id AND ck.node_id = c.node_id
      WHERE r.parent_id IS NULL AND rk.n = 2 AND rk.nl = 1 AND ck.nl = 1)
SELECT a.tree_id, n_nodes, n_leaves, height, sum_height, is_binary, max_children, cherries,
  cherries + CASE WHEN a.tree_id IN (SELECT tree_id FROM h) THEN 1 ELSE 0 END AS unrooted_cherries,
  {sql_round("total_length")} AS total_length, {sql_round("root_to_tip")} AS root_to_tip,
  {sql_round("sum_height / n_leaves")} AS avg_height
FROM a JOIN s USING (tree_id)"""


# Depth after resolution: child m of k lies k-1 (first two) or k-m levels down.
RESOLVED = f"""{FOREST},
sized AS (
  SELECT tree_id, node_id, parent_id, length, is_leaf, depth,
    row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY node_id) - 1 AS m,
    count(*) OVER (PARTITION BY tree_id, parent_id) AS k FROM nodes),
stepped AS (
  SELECT *, CASE WHEN depth = 0 OR k = 1 THEN 0 WHEN k = 2 THEN 1
                 WHEN m = 0 THEN k - 1 ELSE k - m END AS step FROM sized),
kids AS (SELECT tree_id, parent_id AS node_id, count(*) AS n FROM nodes
         WHERE parent_id IS NOT NULL GROUP BY ALL),
deep AS (
  SELECT c.tree_id, c.node_id, c.is_leaf, c.length, kids.n,
         c.step + coalesce(p.step, 0) AS rdepth, p.length AS plength, pk.n AS pn
  FROM stepped c LEFT JOIN stepped p ON c.tree_id = p.tree_id AND c.parent_id = p.node_id
  LEFT JOIN kids ON kids.tree_id = c.tree_id AND kids.node_id = c.node_id
  LEFT JOIN kids pk ON pk.tree_id = c.tree_id AND pk.node_id = c.parent_id),
kept AS (SELECT * FROM deep WHERE n IS DISTINCT FROM 1),
wraps AS (
  SELECT s.tree_id, (s.k - 1 - s.m) + coalesce(p.step, 0) AS wdepth
  FROM stepped s LEFT JOIN stepped p ON s.tree_id = p.tree_id AND s.parent_id = p.node_id
  WHERE s.depth > 0 AND s.k > 2 AND s.m BETWEEN 1 AND s.k - 2)
"""

_RESOLVE_FOREST = f"""
WITH {RESOLVED},
up AS (SELECT tree_id, max(tip) AS root_to_tip FROM (
   SELECT c.tree_id,
          CASE WHEN c.rdepth = 0 THEN 0 ELSE c.length END
          + CASE WHEN c.pn = 1 OR c.plength IS NULL OR root_k.n = 1 THEN 0 ELSE c.plength END AS tip
   FROM kept c LEFT JOIN kids root_k ON root_k.tree_id = c.tree_id AND root_k.node_id = -1
   WHERE c.is_leaf) GROUP BY tree_id),
wcount AS (SELECT tree_id, count(*) AS w FROM wraps GROUP BY tree_id),
a AS (SELECT tree_id, count(*) AS n0, count(*) FILTER (WHERE is_leaf) AS n_leaves,
        sum(length) AS total_length, CAST(max(rdepth) FILTER (WHERE is_leaf) AS BIGINT) AS height,
        CAST(sum(rdepth) FILTER (WHERE is_leaf) AS BIGINT) AS sum_height FROM kept GROUP BY tree_id)
SELECT a.tree_id, n0 + coalesce(w, 0) AS n_nodes, n_leaves, height, sum_height,
  TRUE AS is_binary, CAST(CASE WHEN n_leaves > 1 THEN 2 ELSE 0 END AS BIGINT) AS max_children,
  {sql_round("total_length")} AS total_length, {sql_round("root_to_tip")} AS root_to_tip,
  {sql_round("sum_height / n_leaves")} AS avg_height
FROM a LEFT JOIN wcount USING (tree_id) JOIN up USING (tree_id)"""

_PRUNING = f"""
WITH {RESOLVED},
places AS (
  SELECT tree_id, CASE WHEN is_leaf THEN 2 * rdepth - 1 ELSE 2 * rdepth END AS d FROM kept WHERE rdepth > 0
  UNION ALL SELECT tree_id, 2 * wdepth FROM wraps)
SELECT tree_id, CAST(max(d) AS BIGINT) AS pruning_height, {sql_round("avg(d)")} AS pruning_avg_height
FROM places GROUP BY tree_id"""

QUERIES = {
    "tree_nodes_fk": Query(
        tree_nodes,
        f"""WITH {SUPPLIER_TREE},
sizes AS (SELECT node_id, 1 AS s FROM walk UNION ALL SELECT parent_id, 1 FROM walk WHERE parent_id IS NOT NULL
  UNION ALL SELECT p.parent_id, 1 FROM walk w JOIN walk p ON w.parent_id = p.node_id WHERE p.parent_id IS NOT NULL
  UNION ALL SELECT 0, 1 FROM walk WHERE depth = 3)
SELECT node_id, parent_id, label, CAST(depth AS BIGINT) AS depth, {sql_round("dist")} AS dist, pre, post,
  (SELECT count(*) FROM sizes s WHERE s.node_id = walk.node_id) AS subtree_size FROM walk"""),
    "tree_metrics_fk": Query(
        tree_metrics_fk, _metrics_sql(f"{SUPPLIER_TREE}, walked AS (SELECT * FROM walk)",
                                      "CAST(0 AS BIGINT)")),
    "tree_metrics_forest": Query(
        tree_metrics_forest, _metrics_sql(f"{FOREST}, walked AS (SELECT * FROM nodes)")),
    "tree_scale": Query(
        tree_scale,
        f"WITH {FOREST} SELECT tree_id, {sql_round('sum(length) / max(dist) FILTER (WHERE is_leaf)')} "
        "AS total_length FROM nodes GROUP BY tree_id"),
    "tree_ultrametric_fk": Query(
        tree_ultrametric,
        f"WITH {SUPPLIER_TREE} SELECT node_id, {sql_round('CASE WHEN is_leaf THEN length + (SELECT max(dist) FROM walk WHERE is_leaf) - dist ELSE length END')} AS length FROM walk"),
    "branch_ids_fk": Query(
        branch_ids,
        f"WITH {SUPPLIER_TREE} SELECT node_id, -((SELECT count(*) FROM walk WHERE is_leaf) + "
        "row_number() OVER (ORDER BY post) - 1) AS branch_id FROM walk "
        "WHERE NOT is_leaf AND parent_id IS NOT NULL"),
    "leftmost_heights_fk": Query(
        leftmost_heights,
        f"WITH {SUPPLIER_TREE} SELECT w.node_id, {sql_round('(SELECT arg_min(l.dist, l.pre) FROM walk l WHERE l.is_leaf AND l.pre >= w.pre) - w.dist')} AS height FROM walk w"),
    "node_heights_forest": Query(
        node_heights,
        f"""WITH RECURSIVE {FOREST},
up AS (SELECT tree_id, node_id, parent_id, 0 AS h FROM nodes WHERE is_leaf
  UNION ALL SELECT n.tree_id, n.node_id, n.parent_id, h + 1 FROM up JOIN nodes n
    ON n.tree_id = up.tree_id AND n.node_id = up.parent_id)
SELECT tree_id, node_id, CAST(max(h) AS BIGINT) AS edge_height FROM up GROUP BY tree_id, node_id"""),
    "insert_siblings_fk": Query(
        insert_siblings,
        f"""WITH {SUPPLIER_TREE},
grown AS (SELECT label, depth, k1, k2, 0 AS sub, k3 FROM nodes
  UNION ALL SELECT label || '+', depth, k1, k2, 1, -1 FROM nodes WHERE depth = 2)
SELECT label, row_number() OVER (ORDER BY depth > 0, k1, k2, sub, k3) - 1 AS pre FROM grown"""),
    "graft_siblings_fk": Query(
        graft_siblings,
        f"""WITH {SUPPLIER_TREE},
grown AS (SELECT label, length, depth > 0 AS a, k1 AS b, 0 AS c, FALSE AS d, 0 AS e, k2, k3 FROM nodes
  UNION ALL SELECT label, length, TRUE, (SELECT min(k1) FROM nodes WHERE depth = 1), 1, depth > 0, k1, k2, k3 FROM nodes)
SELECT label, {sql_round("length")} AS length, row_number() OVER (ORDER BY a, b, c, d, e, k2, k3) - 1 AS pre FROM grown"""),
    "clock_check_forest": Query(
        clock_check,
        f"""WITH {FOREST},
tips AS (SELECT *, dist - first_value(dist) OVER (PARTITION BY tree_id ORDER BY node_id) AS g FROM nodes WHERE is_leaf),
inner_gap AS (SELECT tree_id, parent_id, max(abs(dist - fd)) AS g FROM (
   SELECT tree_id, parent_id, dist, first_value(dist) OVER (PARTITION BY tree_id, parent_id ORDER BY node_id) AS fd
   FROM nodes WHERE is_leaf) GROUP BY ALL),
firsts AS (SELECT tree_id, parent_id, arg_min(dist, node_id) AS fd FROM nodes WHERE is_leaf GROUP BY ALL),
root_gap AS (SELECT tree_id, max(abs(fd - ff)) AS g FROM (
   SELECT tree_id, fd, first_value(fd) OVER (PARTITION BY tree_id ORDER BY parent_id) AS ff FROM firsts) GROUP BY tree_id)
SELECT tree_id, greatest(max(i.g), max(r.g)) <= 1e-5 AS is_clock, TRUE AS is_clock_after
FROM inner_gap i JOIN root_gap r USING (tree_id) GROUP BY tree_id"""),
    "lengths_from_heights_fk": Query(
        lengths_from_heights,
        f"""WITH {SUPPLIER_TREE}, h AS (SELECT *, (SELECT max(dist) FROM walk) - dist AS height FROM walk)
SELECT c.node_id, {sql_round("coalesce(p.height - CASE WHEN c.is_leaf THEN 0 ELSE c.height END, c.length)")} AS length
FROM h c LEFT JOIN h p ON c.parent_id = p.node_id"""),
    "node_times_forest": Query(
        node_times,
        f"WITH {FOREST} SELECT tree_id, is_leaf, count(*) AS n, {sql_round('sum(dist)')} AS sum_times "
        "FROM nodes GROUP BY ALL"),
    "child_counts_forest": Query(
        child_counts,
        f"WITH {FOREST} SELECT tree_id, parent_id AS node_id, count(*) AS n_children, "
        "count(*) FILTER (WHERE is_leaf) AS n_leaf_children FROM nodes "
        "WHERE parent_id IS NOT NULL GROUP BY ALL"),
    "contract_edges_forest": Query(
        contract_edges,
        f"""WITH {FOREST}
SELECT tree_id, node_id, CASE WHEN depth = 0 THEN NULL ELSE CAST(-1 AS BIGINT) END AS parent_id,
  row_number() OVER (PARTITION BY tree_id, depth ORDER BY parent_id, node_id DESC) - 1 AS child_ord,
  {sql_round("length")} AS length FROM nodes WHERE depth <> 1"""),
    "erase_subtree_fk": Query(
        erase_subtree,
        f"WITH {SUPPLIER_TREE} SELECT node_id, parent_id, label FROM walk "
        "WHERE depth = 0 OR k1 <> (SELECT min(r_regionkey) FROM reg)"),
    "subtree_scan_fk": Query(
        subtree_scan,
        f"WITH {SUPPLIER_TREE} SELECT node_id, label, pre FROM walk "
        "WHERE depth > 0 AND k1 = (SELECT min(r_regionkey) FROM reg)"),
    "graft_forest": Query(
        graft_trees,
        _metrics_sql(f"""{FOREST}, walked AS (SELECT * FROM nodes UNION ALL
  SELECT tree_id, node_id + 1000000000000, CASE WHEN depth = 0 THEN CAST(-1 AS BIGINT) ELSE parent_id + 1000000000000 END,
         length, is_leaf, depth + 1, dist FROM nodes)""")),
    "insert_children_forest": Query(
        insert_children,
        _metrics_sql(f"""{FOREST}, walked AS (
  SELECT tree_id, node_id, parent_id, length, FALSE AS is_leaf, depth, dist FROM nodes
  UNION ALL SELECT tree_id, -node_id * 2 - 10 - k, node_id, k * 0.01, TRUE, 3, dist + k * 0.01
  FROM nodes, (VALUES (1), (2)) AS v(k) WHERE is_leaf)""")),
    "reroot_forest": Query(
        reroot_forest,
        f"""WITH {FOREST}, f AS (SELECT tree_id, min(node_id) AS new_root FROM nodes WHERE depth = 1 GROUP BY tree_id)
SELECT tree_id, node_id,
  CASE WHEN node_id = new_root THEN NULL WHEN depth = 0 THEN new_root ELSE parent_id END AS parent_id,
  {sql_round('''CASE WHEN node_id = new_root THEN 0 WHEN depth = 0 THEN
     (SELECT r.length FROM nodes r WHERE r.tree_id = nodes.tree_id AND r.node_id = new_root) ELSE length END''')} AS length
FROM nodes JOIN f USING (tree_id)"""),
    "reverse_children_fk": Query(
        reverse_children,
        f"""WITH {SUPPLIER_TREE}
SELECT node_id, label,
  row_number() OVER (ORDER BY depth > 0, k1 DESC, depth > 1, k2 DESC, depth > 2, k3 DESC) - 1 AS pre,
  row_number() OVER (ORDER BY depth = 0, k1 DESC, depth <= 1, k2 DESC, depth <= 2, k3 DESC) - 1 AS post
FROM walk"""),
    "topology_check_forest": Query(
        topology_check,
        f"""WITH {FOREST}, gone AS (SELECT o_orderkey * 8 AS node_id FROM orders WHERE o_orderstatus = 'F')
SELECT tree_id, node_id, parent_id FROM nodes WHERE is_leaf AND parent_id IN (SELECT node_id FROM gone)"""),
    "tree_equality_fk": Query(
        tree_equality,
        f"""WITH {SUPPLIER_TREE}, mirror AS (SELECT label,
  row_number() OVER (ORDER BY depth > 0, k1 DESC, depth > 1, k2 DESC, depth > 2, k3 DESC) - 1 AS pre,
  row_number() OVER (ORDER BY depth = 0, k1 DESC, depth <= 1, k2 DESC, depth <= 2, k3 DESC) - 1 AS post FROM walk)
SELECT w.pre, w.post, w.label FROM walk w JOIN mirror m ON w.pre = m.pre AND w.post = m.post AND w.label = m.label"""),
    "tree_pairs_equal": Query(
        tree_pairs_equal,
        f"""WITH {FOREST}, placed AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY node_id) - 1 AS pre FROM nodes),
diff AS (SELECT tree_id, min(pre) FILTER (is_leaf AND node_id % 37 = 0) AS first_difference FROM placed GROUP BY tree_id)
SELECT tree_id AS left_id, tree_id AS right_id, first_difference IS NULL AS equal, first_difference FROM diff"""),
    "resolve_forest": Query(resolve_forest, _RESOLVE_FOREST),
    "resolve_fk": Query(
        resolve_fk,
        f"""WITH {SUPPLIER_TREE},
st AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY node_id) - 1 AS m,
         count(*) OVER (PARTITION BY parent_id) AS k FROM walk),
sp AS (SELECT node_id, parent_id, is_leaf, length, k, CASE WHEN depth = 0 OR k = 1 THEN 0 WHEN k = 2 THEN 1
        WHEN m = 0 THEN k - 1 ELSE k - m END AS step FROM st),
kids AS (SELECT parent_id AS node_id, count(*) AS n FROM walk GROUP BY 1),
d AS (SELECT c.*, c.step + p.step + g.step AS rdepth FROM sp c JOIN sp p ON c.parent_id = p.node_id
      JOIN sp g ON p.parent_id = g.node_id WHERE c.is_leaf),
a AS (SELECT count(*) AS n_leaves, CAST(max(rdepth) AS BIGINT) AS height,
        CAST(sum(rdepth) AS BIGINT) AS sum_height FROM d)
SELECT CAST(0 AS BIGINT) AS tree_id, 2 * n_leaves - 1 AS n_nodes, n_leaves, height, sum_height,
  TRUE AS is_binary, CAST(2 AS BIGINT) AS max_children,
  {sql_round("(SELECT sum(length) FROM sp WHERE node_id NOT IN (SELECT node_id FROM kids WHERE n = 1 AND node_id IS NOT NULL))")} AS total_length,
  {sql_round("sum_height / n_leaves")} AS avg_height FROM a"""),
    "pruning_heights_forest": Query(pruning_heights, _PRUNING),
    "pruning_table_forest": Query(pruning_table, _PRUNING),
    "decomp_sizes_forest": Query(
        decomp_sizes,
        f"""WITH {RESOLVED},
a AS (SELECT tree_id, count(*) FILTER (WHERE is_leaf) AS n,
        sum(length) FILTER (WHERE rdepth > 0) AS total_length FROM kept GROUP BY tree_id)
SELECT tree_id, 4 * n - 5 AS n_components, 2 * n - 2 AS n_edges, 2 * n - 3 AS n_merges,
  {sql_round("total_length")} AS total_length FROM a WHERE n >= 2"""),
    "decomp_table_forest": Query(decomp_table),
    "decomp_heights_forest": Query(decomp_heights),
}
