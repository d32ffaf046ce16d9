"""Newick trees as node tables, parsed and printed with built-in functions only.

Node table: tree_id, node_id, parent_id (NULL at the root), child_ord, label,
meta, length, is_leaf, depth, pre, post. ``pre`` and ``post`` are 0-based
preorder and postorder numbers in the tree; parsed nodes use ``post`` as id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cladeloom.operators.ranking import global_rank
from cladeloom.session import materialize

# The token classes of the format.
TOKEN = r"\[[^\]]*\]|[(),:]|[^(),:;\[\]]+"
OUTSIDE_COMMENT = r"(?![^\[]*\])"
ODD_LENGTH = r":(?![+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?([,()\[\]:;]|$))"
NONE, OPEN, CLOSE, COMMA, COLON, NOTE, WORD = range(7)
PARSED = [StructField(name, kind) for name, kind in (
    ("node_id", LongType()), ("parent_id", LongType()), ("child_ord", LongType()), ("label", StringType()),
    ("meta", StringType()), ("length", DoubleType()), ("is_leaf", BooleanType()), ("depth", IntegerType()),
    ("pre", LongType()), ("post", LongType()), ("broken", BooleanType()))]
BATCH_CHARS = 1 << 22  # characters of whole texts parsed at a time
TREE_START = r"(?<=[^,(])(?=\()"


def read_newick_text(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """(file, tree_number, newick): one row per tree of one or many files.

    Files split at ';', so a large file is read by many tasks. Tree numbers
    run from 1 in file order; they come from one small count per file split.
    Text with an unbalanced comment fails or, without ``strict``, is a tree
    whose ``newick`` is NULL.
    """
    lines = spark.read.text(paths, lineSep=";").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", r"\s+", "").alias("text"),
    )
    # NULL-safe guard: a ';' inside a comment would have cut the record in two.
    lines = lines.filter("text != ''").withColumn(
        "text",
        F.when(
            F.length(F.regexp_replace("text", r"[^\[]", ""))
            != F.length(F.regexp_replace("text", r"[^\]]", "")),
            F.raise_error(F.concat(F.lit("unbalanced comment near: "), F.col("text"))) if strict else F.lit(None),
        ).otherwise(F.col("text")),
    )
    trees = lines.select(
        "file", "_start", "_at",
        F.posexplode_outer(F.split("text", TREE_START + OUTSIDE_COMMENT)).alias("_k", "newick"),
    )
    trees = materialize(trees, "tree_texts")  # one scan: places depend on its splits
    within = F.struct("_at", "_k")
    splits = trees.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    in_split = Window.partitionBy("file", "_start").orderBy(within)
    return trees.withColumn("_row", F.row_number().over(in_split)).join(
        offsets, ["file", "_start"]
    ).select("file", (F.col("_before") + F.col("_row")).alias("tree_number"), "newick")


def _fail_if(bad: Column, message: str, value: Column) -> Column:
    return F.when(
        bad, F.raise_error(F.concat(F.lit(message + " in tree "), F.col("tree_id").cast("string")))
    ).otherwise(value)


def parse_newick(trees: DataFrame, default_length: float = 0.0) -> DataFrame:
    """Node table of (tree_id, newick); a malformed tree fails. Text before the first ';' is the tree."""
    nodes = _parsed(trees, default_length)
    checked = nodes.withColumn("node_id", _fail_if(F.col("broken"), "malformed Newick", F.col("node_id")))
    # Written whole, so that no later choice of columns prunes a check away.
    return materialize(checked.drop("broken"), "parsed")


def parse_newick_or_reject(trees: DataFrame, default_length: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Node table of the well-formed trees of (tree_id, newick), and the ids (tree_id) of all others."""
    nodes = materialize(_parsed(trees, default_length).filter("NOT broken").drop("broken"), "parsed")
    good = nodes.filter("parent_id IS NULL").select("tree_id")
    return nodes, trees.select("tree_id").join(good, "tree_id", "left_anti")


def read_trees(spark: SparkSession, paths: list[str], default_length: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Node table of every tree that can be read, and (file, tree_number, reason) of what cannot.

    A missing file, or a malformed tree in a file, leaves the others as they are.
    ``tree_id`` is (file, tree_number); a missing file has no tree number.
    """
    there, missing = [], []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        (there if system.globStatus(place) else missing).append(path)
    lost = spark.createDataFrame([(p, None, "cannot be read") for p in missing], "file string, tree_number bigint, reason string")
    texts = read_newick_text(spark, there, strict=False) if there else spark.createDataFrame(
        [], "file string, tree_number bigint, newick string")
    trees = materialize(texts.select(F.struct("file", "tree_number").alias("tree_id"), "newick"), "tree_texts")
    nodes, rejected = parse_newick_or_reject(trees, default_length)
    malformed = rejected.select("tree_id.file", "tree_id.tree_number", F.lit("malformed").alias("reason"))
    return nodes, materialize(lost.unionByName(malformed), "rejects")


def _parsed(trees: DataFrame, default_length: float) -> DataFrame:
    """Nodes with ``broken``, whether their tree is malformed.

    Texts are parsed where they lie, batch by batch. Where a colon is followed by
    anything but a plain decimal number, Spark's own cast decides (``_parsed_by_windows``).
    """
    text = F.split(F.regexp_replace("newick", r"\s+", ""), ";" + OUTSIDE_COMMENT)[0]
    trees = trees.select("tree_id", text.alias("newick"))
    odd = F.col("newick").rlike(ODD_LENGTH)
    schema = StructType([trees.schema["tree_id"], *PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("newick").fill_null("").to_pylist()
            ends = np.cumsum([len(t) for t in sizes])
            cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_CHARS)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    out = _nodes_of(batch.column("tree_id").slice(lo, hi - lo), sizes[lo:hi], default_length)
                    yield from out.combine_chunks().to_batches()

    plain = trees.filter(~odd).mapInArrow(run, schema)
    return plain.unionByName(_parsed_by_windows(trees.filter(odd), default_length))


def _nodes_of(ids: pa.Array, texts: list[str], default_length: float) -> pa.Table:
    """Node table of some texts; the tokens of all of them lie in one array."""
    split = [re.findall(TOKEN, t) for t in texts]
    tokens = [t for tree in split for t in tree]
    many = np.array([len(tree) for tree in split], np.int64)
    tree = np.repeat(np.arange(len(split)), many)
    n = len(tokens)
    kinds = {"(": OPEN, ")": CLOSE, ",": COMMA, ":": COLON, "[": NOTE}
    kind = np.fromiter((kinds.get(t[0], WORD) for t in tokens), np.int8, n)

    def shifted(by: int) -> np.ndarray:
        """Kinds of the tokens ``by`` places on in the same tree, else NONE."""
        at = np.arange(n) + by
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        return np.where(inside & (tree[at] == tree), kind[at], NONE) if n else kind

    def per_tree(steps: np.ndarray) -> np.ndarray:
        total = np.cumsum(steps)
        heads = np.cumsum(many) - many
        return total - np.repeat((np.append(0, total)[heads]), many)

    prev, follow = shifted(-1), [shifted(k) for k in range(1, 5)]
    opened, closed, word = kind == OPEN, kind == CLOSE, kind == WORD
    starts = np.isin(prev, (NONE, OPEN, COMMA))
    leaf = word & starts
    node = leaf | closed
    labelled = closed & (follow[0] == WORD)
    a, b = np.where(labelled, follow[1], follow[0]), np.where(labelled, follow[2], follow[1])
    c = np.where(labelled, follow[3], follow[2])
    noted = a == NOTE
    skip = np.where(a == COLON, 1, np.where(noted & (b == COLON), 2, 0))
    valued = (skip > 0) & (np.where(skip == 1, b, c) == WORD)
    level = per_tree(opened.astype(np.int64) - closed)
    misplaced = (
        (np.isin(kind, (COMMA, CLOSE)) & starts)
        | (word & ~starts & ~np.isin(prev, (CLOSE, COLON)))
        | (opened & ~starts)
        | ((kind == COMMA) & (level < 1))
        | (level < 0)
        | ((kind == COLON) & (follow[0] != WORD))
    )
    broken = np.bincount(tree, misplaced, len(split)) > 0
    broken |= np.bincount(tree, opened.astype(float) - closed, len(split)) != 0
    post, pre = per_tree(node.astype(np.int64)) - 1, per_tree((opened | leaf).astype(np.int64)) - 1

    # Keys (tree, level, place): the enclosing bracket closes next one level up, a bracket opened last on its own.
    wide, low = int(level.max(initial=0) - level.min(initial=0)) + 4, int(level.min(initial=0)) - 2
    key = (tree * wide + level - low) * (n + 1) + np.arange(n)
    at = np.flatnonzero(node)
    closes, opens = np.flatnonzero(closed), np.flatnonzero(opened)
    order = closes[np.argsort(key[closes])]
    asked = key[at] - (n + 1)
    nearest = np.searchsorted(key[order], asked)
    found = np.append(order, 0)[nearest]
    has = (nearest < len(order)) & (key[found] // (n + 1) == asked // (n + 1)) if n else nearest < 0
    own = (tree[opens] * wide + level[opens] - 1 - low) * (n + 1) + opens
    rank = np.argsort(own)
    mine = np.append(rank, 0)[np.maximum(np.searchsorted(own[rank], key[at]) - 1, 0)]
    first = np.where(leaf[at], pre[at], pre[np.append(opens, 0)[mine]] if len(opens) else pre[at])
    family = np.where(has, found, n + at)
    line = np.lexsort((at, family))
    place = np.zeros(len(at), np.int64)
    heads = np.flatnonzero(np.diff(family[line], prepend=-1))
    place[line] = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))

    start = at + 1 + labelled[at]  # where a comment or a colon may stand
    lengths = [float(tokens[s + k]) if v else default_length for s, k, v in zip(start.tolist(), skip[at].tolist(), valued[at].tolist())]
    labels = [tokens[k] if f else tokens[k + 1] if m else None for k, f, m in zip(at.tolist(), leaf[at].tolist(), labelled[at].tolist())]
    notes = [re.sub(r"^\[|\]$", "", tokens[s]) if m else None for s, m in zip(start.tolist(), noted[at].tolist())]
    return pa.table({
        "tree_id": ids.take(pa.array(tree[at])), "node_id": post[at],
        "parent_id": pa.array(post[found] if n else post[at], mask=~has), "child_ord": place,
        "label": pa.array(labels, pa.string()), "meta": pa.array(notes, pa.string()), "length": pa.array(lengths, pa.float64()),
        "is_leaf": leaf[at], "depth": level[at].astype(np.int32), "pre": first, "post": post[at], "broken": broken[tree[at]],
    })


def _parsed_by_windows(trees: DataFrame, default_length: float) -> DataFrame:
    tokens = trees.repartition("tree_id").select(
        "tree_id", F.posexplode(F.regexp_extract_all("newick", F.lit(TOKEN), 0)).alias("at", "tok")
    )
    w = Window.partitionBy("tree_id").orderBy("at")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("tree_id")

    tokens = tokens.withColumn("prev", F.lag("tok").over(w))
    for k in range(1, 5):
        tokens = tokens.withColumn(f"n{k}", F.lead("tok", k).over(w))
    word = ~F.col("tok").isin("(", ")", ",", ":") & ~F.col("tok").startswith("[")
    starts_item = F.col("prev").isNull() | F.col("prev").isin("(", ",")
    opened, closed = F.col("tok") == "(", F.col("tok") == ")"
    leaf = word & starts_item
    node = leaf | closed
    labelled = closed & F.col("n1").isNotNull() & ~F.col("n1").isin("(", ")", ",", ":") & (
        ~F.col("n1").startswith("[")
    )
    a, b, c = (
        F.when(labelled, F.col(f"n{k + 1}")).otherwise(F.col(f"n{k}")) for k in (1, 2, 3)
    )
    commented = a.startswith("[")
    length = F.when(a == ":", b).when(commented & (b == ":"), c)
    tokens = (
        tokens.withColumn("is_node", node)
        .withColumn("is_leaf", leaf)
        .withColumn("label", F.when(leaf, F.col("tok")).when(labelled, F.col("n1")))
        .withColumn("meta", F.when(commented, F.regexp_replace(a, r"^\[|\]$", "")))
        .withColumn("length", F.coalesce(length.try_cast("double"), F.lit(default_length)))
        .withColumn("level", F.sum(opened.cast("int") - closed.cast("int")).over(up_to))
    )
    misplaced = (
        (F.col("tok").isin(",", ")") & (F.col("prev").isNull() | F.col("prev").isin("(", ",")))
        | (word & ~starts_item & ~F.col("prev").isin(")", ":"))
        | (opened & ~starts_item)
        | ((F.col("tok") == ",") & (F.col("level") < 1))
        | (F.col("level") < 0)
        | ((F.col("tok") == ":") & (F.col("n1").try_cast("double").isNull()))
    )
    tokens = (
        tokens.withColumn("bad", F.max(F.coalesce(misplaced, F.lit(False))).over(whole))
        .withColumn("open_left", F.sum(opened.cast("int") - closed.cast("int")).over(whole))
        .withColumn("post", F.sum(F.col("is_node").cast("bigint")).over(up_to) - 1)
        .withColumn("pre", F.sum((opened | leaf).cast("bigint")).over(up_to) - 1)
    )
    # An opening bracket and its closing one are the k-th pair of their level.
    pair_level = F.when(opened, F.col("level") - 1).when(closed, F.col("level"))
    pair = Window.partitionBy("tree_id", "pair_level").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    tokens = (
        tokens.withColumn("pair_level", pair_level)
        .withColumn("open_pre", F.last(F.when(opened, F.col("pre")), True).over(pair))
        .filter("is_node")
        .withColumn("depth", F.col("level").cast("int"))
    )
    # The parent is the next node to close one level up.
    roles = tokens.withColumn(
        "up", F.explode(F.when(F.col("is_leaf"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    ).withColumn("ring", F.col("depth") - F.col("up"))
    ring = Window.partitionBy("tree_id", "ring").orderBy(F.col("post").desc(), F.col("up").desc())
    nodes = roles.withColumn(
        "parent_id", F.last(F.when(F.col("up") == 0, F.col("post")), True).over(ring)
    ).filter("up = 1")
    siblings = Window.partitionBy("tree_id", "parent_id").orderBy("post")
    broken = F.col("bad") | (F.col("open_left") != 0)
    return nodes.select(
        "tree_id",
        F.col("post").alias("node_id"),
        "parent_id",
        (F.row_number().over(siblings) - 1).cast("bigint").alias("child_ord"),
        "label", "meta", "length", "is_leaf", "depth",
        F.when(F.col("is_leaf"), F.col("pre")).otherwise(F.col("open_pre")).alias("pre"),
        "post",
        broken.alias("broken"),
    )


def attach_taxa(nodes: DataFrame, taxa: DataFrame, check: bool = True) -> DataFrame:
    """Leaf labels to ``taxon_id``; an unknown leaf fails, or stays NULL without ``check``."""
    named = nodes.join(
        taxa.select(F.col("taxon").alias("label"), "taxon_id"), "label", "left"
    ).withColumn("taxon_id", F.when(F.col("is_leaf"), F.col("taxon_id")))
    if not check:
        return named
    unknown = F.col("is_leaf") & F.col("taxon_id").isNull()
    message = F.concat(F.lit("taxon "), F.col("label"), F.lit(" in tree is not in the alignment"))
    return materialize(named.withColumn(
        "taxon_id", F.when(unknown, F.raise_error(message)).otherwise(F.col("taxon_id"))
    ), "named")


def attach_new_taxa(nodes: DataFrame, taxa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``taxon_id``, and taxa (taxon, taxon_id) with the unknown leaves appended.

    New taxa are numbered after the largest known number, by where they first appear: tree
    by tree, in preorder.
    """
    largest = taxa.agg(F.coalesce(F.max("taxon_id"), F.lit(-1)).cast("bigint").alias("m")).first()["m"]
    leaves = nodes.filter("is_leaf AND label IS NOT NULL")
    unknown = leaves.join(taxa.select(F.col("taxon").alias("label")), "label", "left_anti")
    first = unknown.groupBy("label").agg(F.min(F.struct("tree_id", "pre")).alias("_first"))
    placed = global_rank(first, [F.col("_first")], "_rank")
    new = placed.select(F.col("label").alias("taxon"), (F.col("_rank") + largest + 1).alias("taxon_id"))
    every = materialize(taxa.select("taxon", F.col("taxon_id").cast("bigint")).unionByName(new), "taxa")
    return attach_taxa(nodes, every), every


def to_newick(
    nodes: DataFrame, name: str = "label", lengths: bool = True, meta: bool = False
) -> DataFrame:
    """(tree_id, newick), without the final ';'.

    A node opens after all nodes before it in preorder have opened and all but
    its ancestors have closed, which gives every bracket its place directly
    from ``pre``, ``post`` and ``depth``; no recursion is needed.
    """
    tail = F.coalesce(F.col(name).cast("string"), F.lit(""))
    if meta:
        tail = F.concat(
            tail, F.when(F.coalesce("meta", F.lit("")) != "",
                         F.concat(F.lit("["), F.col("meta"), F.lit("]"))).otherwise("")
        )
    if lengths:
        tail = F.concat(tail, F.lit(":"), F.col("length").cast("string"))
    comma = F.when(F.col("first"), F.lit("")).otherwise(F.lit(","))
    # A first child opens right after its parent, the only node one level up it can follow.
    before = F.lag("depth").over(Window.partitionBy("tree_id").orderBy("pre"))
    placed = nodes.withColumn("first", F.coalesce(before < F.col("depth"), F.lit(True)))
    opening = F.struct(
        (2 * F.col("pre") - F.col("depth")).alias("at"),
        F.concat(comma, F.when(F.col("is_leaf"), F.lit("")).otherwise(F.lit("("))).alias("s"),
    )
    closing = F.struct(
        (2 * F.col("post") + F.col("depth") + 1).alias("at"),
        F.concat(F.when(F.col("is_leaf"), F.lit("")).otherwise(F.lit(")")), tail).alias("s"),
    )
    pieces = placed.select("tree_id", F.explode(F.array(opening, closing)).alias("p"))
    return pieces.groupBy("tree_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias(
            "newick"
        )
    )


def write_newick(trees: DataFrame, path: str) -> None:
    """One tree per line, closed with ';'."""
    trees.select(F.concat("newick", F.lit(";")).alias("value")).write.text(path)
