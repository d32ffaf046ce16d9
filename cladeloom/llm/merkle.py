"""Merkle manifest of a table: leaves, roots, proofs, and versions by path copying.

Every row is a leaf, a SHA-256 over its fields. The leaves of a language, in order
of their ids, are the bottom of a tree whose nodes hash runs of ``ARITY`` nodes;
the roots of the languages are in the same way the leaves of the tree of the
table.

* Positions come from range partitions and the counts of the partitions before, so
  a language may hold all rows.
* A tier folds aligned blocks of ``BLOCK`` nodes, each in one task, into one node of
  the next tier, until one node is left. From the top down each block then gets the
  steps above it: per level the siblings to its left and right.
* A block is a persistent tree. A changed leaf makes a version: its ancestors in the
  block are copied, all other nodes are shared with the first version, and the
  version goes on along the steps of the distributed tiers above the block. Blocks
  and their steps meet in one join, so versions of all leaves need no further shuffle.

Defined results: a null field counts as ``-`` and differs from every text; null
languages form a tree of their own, the first; null ids come first, rows of one id are
ordered by leaf; equal rows are leaves of their own; an empty table has no rows;
a lone leaf is its own root; columns besides the five named are ignored. A row without
an id is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.session import materialize, metric, sized_partitions

ARITY = 8
LEVELS = 4
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MAX_BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEPS = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(fields: dict[str, Column]) -> Column:
    """The digest of the fields, each with its length, so no two rows run together."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[name]) for name in FIELDS]), 256)


def folded_text() -> Column:
    """The text as a tamperer leaves it: A-Z in lower case."""
    return F.translate(F.col("text").cast("string"), UPPER, LOWER)


def tampered() -> Column:
    """Whether a row is tampered with: every third, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def leaves_of(docs: DataFrame, changed: Column, new_text: Column) -> DataFrame:
    """(tree, doc_id, hash, new_hash): a leaf per row, ``new_hash`` null where ``changed`` does not hold."""
    fields = {name: F.col(name) for name in FIELDS}
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_hash(fields).alias("hash"),
        F.when(changed, leaf_hash(fields | {"text": new_text})).alias("new_hash"),
    )


def positions(rows: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """``rows`` with ``pos``, the place within their ``tree``, and ``size``, its number of rows."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col("tree").asc(), *order, F.col("_row").asc()]
    dealt = keyed.repartitionByRange(partitions, *by).sortWithinPartitions(*by).drop("_row")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    in_tree = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        counts.withColumn("_start", F.coalesce(F.sum("_n").over(in_tree), F.lit(0)))
        .withColumn("size", F.sum("_n").over(Window.partitionBy("tree"))).drop("_n"), "starts")
    if metric(starts) <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    joined = placed.join(starts, ["_part", "tree"])
    return joined.withColumn("pos", F.col("_start") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_start")


def depth(size: int, levels: int = LEVELS) -> int:
    """Levels that a tier folds of a tree that has ``size`` nodes there."""
    found = 0
    while size > 1 and found < levels:
        size, found = -(-size // ARITY), found + 1
    return found


class Node:
    """A node of a persistent tree; never changed once made."""

    __slots__ = ("hash", "children")

    def __init__(self, hash: str, children: tuple[Node, ...] = ()):
        self.hash, self.children = hash, children

    @staticmethod
    def over(children: tuple[Node, ...]) -> Node:
        return Node(digest("".join(c.hash for c in children)), children)


class BlockTree:
    """The tree over the leaves of one aligned block, ``levels`` high."""

    def __init__(self, hashes: list[str], levels: int):
        self.levels = levels
        row = [Node(h) for h in hashes]
        for _ in range(levels):
            row = [Node.over(tuple(row[k:k + ARITY])) for k in range(0, len(row), ARITY)]
        self.root = row[0]

    def path(self, leaf: int) -> list[tuple[Node, int]]:
        """Ancestors of a leaf from the root down, each with the place of the child below."""
        found, node = [], self.root
        for level in range(self.levels - 1, -1, -1):
            at = leaf // ARITY**level % ARITY
            found.append((node, at))
            node = node.children[at]
        return found

    def steps(self, leaf: int) -> list[tuple[str, str]]:
        """From the leaf up: the joined hashes of the siblings to the left and to the right."""
        return [("".join(c.hash for c in node.children[:at]), "".join(c.hash for c in node.children[at + 1:]))
                for node, at in reversed(self.path(leaf))]

    def changed(self, leaf: int, hash: str) -> Node:
        """The root of a version with another leaf; only the ancestors of the leaf are new nodes."""
        node = Node(hash)
        for above, at in reversed(self.path(leaf)):
            node = Node.over((*above.children[:at], node, *above.children[at + 1:]))
        return node


def climb(hash: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        hash = digest(left + hash + right)
    return hash


_FOLDED = "tree string, block bigint, size bigint, root string, hashes array<string>"


def _blocks(nodes: DataFrame, extra: str = "") -> DataFrame:
    """Blocks (tree, block, size, root, hashes) of nodes (tree, pos, size, hash).

    With ``extra`` columns, lists of these are kept beside the hashes.
    """
    names = [part.split()[0] for part in extra.split(",")] if extra else []
    schema = _FOLDED + "".join(f", {part.split()[0]} array<{part.split()[1]}>" for part in extra.split(",") if part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for tree, block, size, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, block, size) != key:
                    if held:
                        yield folded(key, held)
                    key, held = (tree, block, size), []
                held.append(row)
        if held:
            yield folded(key, held)

    def folded(key: tuple, rows: list) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)]
        root = BlockTree(columns[0], depth(key[2])).root.hash
        values = [*key, root, *columns]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("root", pa.string()),
                       ("hashes", pa.list_(pa.string())),
                       *[(part.split()[0], pa.list_(kinds[part.split()[1]])) for part in extra.split(",") if part]])
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))
    dealt = keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select("tree", "block", "size", "hash", *names).mapInArrow(run, schema)


def _tiers(bottom: DataFrame) -> list[DataFrame]:
    """``bottom`` blocks and those of the tiers above, each of the roots of the tier below."""
    tiers = [bottom]
    while (metric(tiers[-1], "largest") or 0) > BLOCK:
        below = tiers[-1].filter(F.col("size") > BLOCK)
        nodes = below.select("tree", F.col("block").alias("pos"),
                             F.ceil(F.col("size") / BLOCK).cast("bigint").alias("size"), F.col("root").alias("hash"))
        tiers.append(materialize(_blocks(nodes), "tier", largest=F.max("size")))
    return tiers


def _child_steps(tier: DataFrame) -> DataFrame:
    """(tree, block, steps, top) for the nodes below a tier of blocks with (steps, top) of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, size, hashes, above, top in zip(*(c.to_pylist() for c in batch.columns)):
                built = BlockTree(hashes, depth(size))
                rows = [{"tree": tree, "block": block * BLOCK + k, "top": top,
                         "steps": [{"left": a, "right": b} for a, b in built.steps(k)] + above} for k in range(len(hashes))]
                yield pa.RecordBatch.from_pylist(rows, schema=_STEPS)

    given = tier.select("tree", "block", "size", "hashes", "steps", "top")
    return given.mapInArrow(run, f"tree string, block bigint, steps {STEPS}, top string")


_STEP_LIST = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_STEPS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("steps", _STEP_LIST), ("top", pa.string())])


def _above(tiers: list[DataFrame]) -> DataFrame:
    """(tree, block, steps, top) of every block of the lowest tier: what lies above it, and the root of its tree."""
    none = F.lit(None).cast(STEPS)
    known = None
    for tier in reversed(tiers):
        own = tier.filter(F.col("size") <= BLOCK).select("tree", "block", F.coalesce(none, F.array().cast(STEPS)).alias("steps"),
                                                         F.col("root").alias("top"))
        if known is not None:
            own = own.unionByName(known)
        own = materialize(own, "above")
        if tier is tiers[0]:
            return own
        known = _child_steps(tier.join(own, ["tree", "block"]))


@dataclass
class Manifest:
    """Blocks of leaves with all that lies above them, and the root of the table.

    ``blocks``: (tree, block, size, hashes, doc_id, new_hash, steps, top, outer, root);
    ``steps`` leads from the block to ``top``, the root of its language, and ``outer``
    from there to ``root``.
    """

    blocks: DataFrame


def build(docs: DataFrame, changed: Column | None = None, new_text: Column | None = None) -> Manifest:
    """The manifest of ``docs``, with the leaves that ``changed`` rows would have under ``new_text``."""
    leaves = leaves_of(docs, F.lit(False) if changed is None else changed,
                       F.col("text") if new_text is None else new_text)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    placed = positions(leaves, order, sized_partitions(docs))
    bottom = materialize(_blocks(placed, "doc_id bigint,new_hash string"), "blocks", largest=F.max("size"))
    above = _above(_tiers(bottom))

    roots = above.groupBy("tree").agg(F.first("top").alias("hash"))
    in_table = positions(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"),
                         [F.col("name").asc()], sized_partitions(roots))
    in_table = materialize(in_table, "languages")
    upper = materialize(_blocks(in_table), "tier", largest=F.max("size"))
    tiers = _tiers(upper)
    whole = _above(tiers).withColumnRenamed("steps", "outer_steps")
    inner = _child_steps(upper.join(whole.withColumnRenamed("outer_steps", "steps"), ["tree", "block"]))
    outer = inner.select(F.col("block").alias("pos"), F.col("steps").alias("outer"), F.col("top").alias("root"))
    of_tree = in_table.join(outer, "pos").select(F.col("name").alias("tree"), "outer", "root")

    small = metric(in_table) <= MAX_BROADCAST_ROWS
    placed_steps = above.join(F.broadcast(of_tree) if small else of_tree, "tree")
    return Manifest(bottom.drop("root").join(placed_steps, ["tree", "block"]))


def proofs(manifest: Manifest) -> DataFrame:
    """A row per leaf: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied).

    ``folded_root`` is the root of the leaf's version, the first one where it is
    unchanged; ``copied`` counts the nodes that its version does not share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                built = BlockTree(row["hashes"], depth(row["size"]))
                above = [(s["left"], s["right"]) for s in row["steps"] + row["outer"]]
                tail, out = "".join(a + b for a, b in above), []
                for k, (doc_id, leaf, new) in enumerate(zip(row["doc_id"], row["hashes"], row["new_hash"])):
                    own = "".join(a + b for a, b in built.steps(k))
                    version = built.root if new is None else built.changed(k, new)
                    reached = climb(version.hash, above)
                    copied = 0 if new is None else built.levels + len(above)
                    out.append((doc_id, leaf, row["top"], row["root"], digest(own + tail), reached,
                                reached == row["root"], copied))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PROOF)], schema=_PROOF)

    return manifest.blocks.select("size", "hashes", "doc_id", "new_hash", "steps", "top", "outer", "root").mapInArrow(
        run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
             "verified boolean, copied bigint")


_PROOF = pa.schema([*[(c, pa.int64() if c == "doc_id" else pa.string()) for c in
                      ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")],
                    ("verified", pa.bool_()), ("copied", pa.int64())])


SQL = r"""
WITH RECURSIVE crc_bytes AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bytes WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bytes WHERE k = 8),
rows AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0 AS hit
  FROM documents, crc_table),
parts AS (SELECT doc_id, lang, hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM rows),
leaves AS (SELECT doc_id, lang, sha256(head || body) AS h, sha256(head || CASE WHEN hit THEN low ELSE body END) AS h2,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM parts),
nodes AS (SELECT lang, 0 AS level, pos, n, h FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
tops AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS level, pos, n, h FROM tops
  UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8),
heights AS (SELECT max(level) AS up FROM upper_nodes),
ladder AS (
  SELECT doc_id, l.lang, k AS level, l.pos >> CAST(3 * k AS BIGINT) AS at FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang, range(t.depth) r(k)),
low_steps AS (
  SELECT a.doc_id, a.lang, a.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < a.at), '') AS lhs,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > a.at), '') AS rhs
  FROM ladder a JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.level = a.level AND s.pos // 8 = a.at // 8 GROUP BY ALL),
up_steps AS (
  SELECT t.lang, t.depth + k AS level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < t.pos >> CAST(3 * k AS BIGINT)), '') AS lhs,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > t.pos >> CAST(3 * k AS BIGINT)), '') AS rhs
  FROM tops t, heights, range(up) r(k) JOIN upper_nodes s ON s.level = k AND s.pos // 8 = (t.pos >> CAST(3 * k AS BIGINT)) // 8 GROUP BY ALL),
steps AS (SELECT * FROM low_steps UNION ALL
  SELECT l.doc_id, l.lang, u.level, u.lhs, u.rhs FROM leaves l JOIN up_steps u ON u.lang IS NOT DISTINCT FROM l.lang),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(lhs || rhs, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id),
climb AS (SELECT doc_id, 0 AS level, h2 AS h FROM leaves
  UNION ALL SELECT c.doc_id, c.level + 1, sha256(s.lhs || c.h || s.rhs) FROM climb c JOIN steps s ON s.doc_id = c.doc_id AND s.level = c.level),
reached AS (SELECT doc_id, max_by(h, level) AS folded_root, max(level) AS high FROM climb GROUP BY doc_id),
top AS (SELECT h AS root FROM upper_nodes WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified, CAST(CASE WHEN crc.hit THEN high ELSE 0 END AS BIGINT) AS copied
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN reached r ON r.doc_id = l.doc_id JOIN parts crc ON crc.doc_id = l.doc_id
LEFT JOIN proof p ON p.doc_id = l.doc_id, top
"""
