"""Trees that fit a task, many per Arrow batch: one shuffle by tree, then arrays over the rows of whole trees.

Every function takes the rows of whole trees and links them by position. A tree with
more rows than a task may hold is handed back, for the joins that take trees of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from cladeloom.operators.ranking import MAX_WINDOW_ROWS
from cladeloom.session import spread

BLOCK_ROWS = 100_000  # rows of whole trees worked on at a time


def by_tree(
    nodes: DataFrame, work: Callable[[pa.Table], pa.Table], fields: list[StructField],
    max_rows: int | None = None,
) -> DataFrame:
    """``work`` on the rows of whole trees, sorted by (tree_id, node_id), after one shuffle or, where they are ``placed``, none.

    Trees of more than ``max_rows`` rows come back as rows with a tree_id and otherwise
    NULL, at least one each. Rows without tree or node are left out. ``tree_id`` and
    ``node_id`` are BIGINT (``has_plain_ids``).
    """
    schema = StructType([StructField("tree_id", LongType()), *fields])
    limit = MAX_WINDOW_ROWS if max_rows is None else max_rows
    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    whole = nodes.filter("tree_id IS NOT NULL AND node_id IS NOT NULL")
    if not is_placed(nodes):
        whole = spread(whole, "tree_id").sortWithinPartitions("tree_id", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, complete in _blocks(batches, limit):
            if complete:
                found = work(_sorted(block))
                cells = [found.column(f.name).cast(f.type) for f in shape]
            else:
                cells = [block.column("tree_id")[:1], *(pa.nulls(1, f.type) for f in list(shape)[1:])]
            yield from pa.Table.from_arrays(cells, schema=shape).combine_chunks().to_batches()

    return whole.mapInArrow(run, schema)


def placed(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``rows`` marked as sorted by tree within their partitions, whole trees in each, as far as ``like`` is."""
    if like is None or is_placed(like):
        rows._cladeloom_placed = True
    return rows


def is_placed(rows: DataFrame) -> bool:
    return getattr(rows, "_cladeloom_placed", False)


def _sorted(block: pa.Table) -> pa.Table:
    trees, nodes = block.column("tree_id").to_numpy(), block.column("node_id").to_numpy()
    if ((np.diff(nodes) >= 0) | (np.diff(trees) != 0)).all():
        return block
    return block.take(pa.array(np.lexsort((nodes, trees))))


def has_plain_ids(nodes: DataFrame) -> bool:
    kinds = dict(nodes.dtypes)
    return kinds["tree_id"] == kinds["node_id"] == kinds["parent_id"] == "bigint"


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of whole trees, or a part of one that is too large, which is not kept."""
    held, rows, large = [], 0, None
    for batch in batches:
        if large is not None:
            batch = batch.filter(pc.not_equal(batch.column("tree_id"), large))
        if not batch.num_rows:
            continue
        large = None
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < min(BLOCK_ROWS, limit):
            continue
        block = pa.concat_tables(held)
        trees = block.column("tree_id").to_numpy()
        last = int(np.searchsorted(trees, trees[-1]))
        yield from _ended(block.slice(0, last), limit)
        held, rows = [block.slice(last)], len(block) - last
        if rows > limit:
            large = pa.scalar(int(trees[-1]), pa.int64())
            yield held[0], False
            held, rows = [], 0
    if rows:
        yield from _ended(pa.concat_tables(held), limit)


def _ended(block: pa.Table, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Complete trees; those beyond the limit apart."""
    if not len(block):
        return
    trees = block.column("tree_id").to_numpy()
    starts = np.flatnonzero(np.diff(trees, prepend=trees[0] - 1))
    sizes = np.diff(np.append(starts, len(trees)))
    for at in np.flatnonzero(sizes > limit):
        yield block.slice(starts[at], sizes[at]), False
    kept = np.repeat(sizes <= limit, sizes)
    if kept.all():
        yield block, True
    elif kept.any():
        yield block.filter(pa.array(kept)), True


def column(block: pa.Table, name: str, empty: int = 0) -> np.ndarray:
    return block.column(name).fill_null(empty).to_numpy()


def links(block: pa.Table) -> np.ndarray:
    """Position of every row's parent; -1 at a root, -2 where the parent is missing."""
    trees, nodes, parents = column(block, "tree_id"), column(block, "node_id"), column(block, "parent_id")
    rooted = block.column("parent_id").is_null().to_numpy()
    tree = np.cumsum(np.diff(trees, prepend=trees[:1]) != 0)
    known = np.unique(nodes)
    near = np.searchsorted(known, parents)
    near[near == len(known)] = 0
    code = tree * len(known) + np.searchsorted(known, nodes)
    asked = tree * len(known) + near
    at = np.searchsorted(code, asked)
    at[at == len(code)] = 0
    met = (known[near] == parents) & (code[at] == asked)
    return np.where(rooted, -1, np.where(met, at, -2))


class Walk:
    """Depth, subtree size, pre- and postorder numbers of linked rows, level by level.

    ``tree``: ascending numbers of trees; ``order``: keys of siblings, most significant
    last as in ``np.lexsort``. Rows that hang below no root have depth -1.
    """

    def __init__(self, tree: np.ndarray, parent: np.ndarray, order: tuple[np.ndarray, ...]):
        n = len(parent)
        self.parent = parent
        kids = np.lexsort((*order, parent))
        kids = kids[np.searchsorted(parent[kids], 0):]
        count = np.bincount(parent[kids], minlength=n)
        first = np.cumsum(count) - count
        roots = np.flatnonzero(parent == -1)
        roots = roots[np.lexsort((*(o[roots] for o in order), tree[roots]))]
        self.count, self.depth = count, np.full(n, -1)
        self.depth[roots] = 0
        self.levels, self.firsts = [roots], [np.diff(tree[roots], prepend=-1) != 0]
        while True:
            above = self.levels[-1]
            above = above[count[above] > 0]
            if not len(above):
                break
            many = count[above]
            starts = np.cumsum(many) - many
            below = kids[np.repeat(first[above] - starts, many) + np.arange(many.sum())]
            heads = np.zeros(len(below), bool)
            heads[starts] = True
            self.depth[below] = len(self.levels)
            self.levels.append(below)
            self.firsts.append(heads)

    def down(self, own: np.ndarray, at_roots: float = 0.0) -> np.ndarray:
        """Sum of ``own`` from below the root to every row."""
        total = np.full(len(own), at_roots)
        for level in self.levels[1:]:
            total[level] = total[self.parent[level]] + own[level]
        return total

    def unknown(self, null: np.ndarray) -> np.ndarray:
        """Rows whose path from the root holds a null."""
        out = np.zeros(len(null), bool)
        if null.any():
            for level in self.levels[1:]:
                out[level] = out[self.parent[level]] | null[level]
        return out

    def deepest(self) -> np.ndarray:
        """Depth of the lowest row at or below every row."""
        out = self.depth.copy()
        for level in self.levels[:0:-1]:
            np.maximum.at(out, self.parent[level], out[level])
        return out

    def leftmost(self, own: np.ndarray) -> np.ndarray:
        """``own`` of the first row without children at or below every row, in preorder."""
        out = own.copy()
        for level, heads in zip(self.levels[:0:-1], self.firsts[:0:-1]):
            out[self.parent[level[heads]]] = out[level[heads]]
        return out

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """(pre, post), counted from 0 in every tree."""
        size = np.ones(len(self.parent), np.int64)
        for level in self.levels[:0:-1]:
            np.add.at(size, self.parent[level], size[level])
        pre = np.zeros(len(self.parent), np.int64)
        for k, (level, heads) in enumerate(zip(self.levels, self.firsts)):
            before = np.cumsum(size[level]) - size[level]
            before -= before[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
            pre[level] = before + (pre[self.parent[level]] + 1 if k else 0)
        return pre, pre - self.depth + size - 1


def tree_numbers(block: pa.Table) -> np.ndarray:
    trees = column(block, "tree_id")
    return np.cumsum(np.diff(trees, prepend=trees[:1]) != 0)
