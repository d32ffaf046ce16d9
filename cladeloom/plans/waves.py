"""Plans of whole blocks of binary trees by arrays, wave by wave.

A wave holds the components made since the last one. Its allowed pairs, in the order of
(higher, lower) number, give a greedy matching; see ``distributed`` for why that is the
plan of merging each component, in order, with its lowest-numbered earlier neighbour.
Components are numbered over the block, in the order they have within their tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cladeloom.operators.blocks import column, links, tree_numbers


class _Edges:
    """Edges of the trees with at least three nodes: leaf edges first, then inner ones, in postorder."""

    def __init__(self, block: pa.Table):
        self.block, self.up, tree = block, links(block), tree_numbers(block)
        self.tip = block.column("is_leaf").fill_null(False).to_numpy()
        self.post = column(block, "post")
        self.kept = (np.bincount(tree) >= 3)[tree]
        rows = np.flatnonzero((self.up >= 0) & self.kept)
        self.rows = rows[np.lexsort((self.post[rows], ~self.tip[rows], tree[rows]))]
        self.tree = tree

    def binary(self) -> bool:
        """One root, two edges below every inner node and none below a leaf, in every tree."""
        below = np.bincount(self.up[self.rows], minlength=len(self.up))
        roots = np.bincount(self.tree[self.kept & (self.up == -1)], minlength=1)
        right = below == np.where(self.tip, 0, 2)
        return bool(right[self.kept].all() and (self.up[self.kept] >= -1).all() and roots.max(initial=0) <= 1)


def _greedy(i: np.ndarray, j: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Places of the pairs, sorted by (i, j), that are taken one by one while both ends are free."""
    alive, won = np.arange(len(i)), []
    first = np.empty(len(used), np.int64)
    while len(alive):
        first[i[alive]] = first[j[alive]] = len(i)
        np.minimum.at(first, i[alive], alive)
        np.minimum.at(first, j[alive], alive)
        best = alive[(first[i[alive]] == alive) & (first[j[alive]] == alive)]
        used[i[best]] = used[j[best]] = True
        won.append(best)
        left = alive[~(used[i[alive]] | used[j[alive]])]
        slow, alive = 4 * len(left) > 3 * len(alive), left
        if slow:  # long chains of pairs, each of which waits for the one before
            taken, chosen = set(), []
            for k, a, b in zip(alive.tolist(), i[alive].tolist(), j[alive].tolist()):
                if a not in taken and b not in taken:
                    taken.update((a, b))
                    chosen.append(k)
            best = np.array(chosen, np.int64)
            used[i[best]] = used[j[best]] = True
            won.append(best)
            break
    return np.sort(np.concatenate(won))


def balanced_block(block: pa.Table, wanted: list[str]) -> pa.Table | None:
    """``wanted`` columns of the balanced plans; None where a tree is not binary."""
    edges = _Edges(block)
    if not edges.binary():
        return None
    rows, tree = edges.rows, edges.tree
    n, total = len(rows), 2 * len(rows) - len(np.unique(tree[rows]))
    top, bud = np.full(total, -1), np.full(total, -1)
    left, right, up = np.full(total, -1), np.full(total, -1), np.full(total, -1)
    kind, layer, slot = (np.zeros(total, np.int64) for _ in range(3))
    span, used = np.full(total, np.nan), np.zeros(total, bool)
    length = block.column("length").cast(pa.float64()).fill_null(np.nan).to_numpy()
    top[:n] = edges.up[rows]
    inner = np.flatnonzero(~edges.tip[rows])
    bud[inner] = rows[inner]
    span[inner] = length[rows[inner]]
    side = np.argsort(top[:n], kind="stable")
    slot[side] = np.arange(n) % 2
    hang = np.full((len(tree), 2), -1)
    hang[top[:n], slot[:n]] = np.arange(n)
    end = np.full(len(tree), -1)
    end[bud[inner]] = inner
    start, stop, waves = 0, n, []
    while start < stop:
        at = np.zeros(len(tree), bool)
        at[top[start:stop]] = True
        at[bud[start:stop][bud[start:stop] >= 0]] = True
        v = np.flatnonzero(at)
        above, low, high = end[v], hang[v].min(axis=1), hang[v].max(axis=1)
        two, met = low >= 0, (above >= 0) & (high >= 0)
        low = np.where(two, low, high)
        low_clade, high_clade = bud[low] < 0, bud[high] < 0
        options = [
            (high, low, 1, two & high_clade & low_clade),
            (high, low, 2, two & high_clade & ~low_clade),
            (low, high, 2, two & low_clade & ~high_clade),
            (above, low, 3, met & two & low_clade),
            (above, high, 3, met & two & high_clade),
            (above, low, 4, met & ~two & low_clade),
            (above, low, 5, met & ~two & ~low_clade),
        ]
        a = np.concatenate([o[0][o[3]] for o in options])
        b = np.concatenate([o[1][o[3]] for o in options])
        how = np.concatenate([np.full(np.count_nonzero(o[3]), o[2]) for o in options])
        i, j = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((j, i))
        order = order[np.searchsorted(i[order], start):]
        if not len(order):
            break
        won = order[_greedy(i[order], j[order], used)]
        a, b, how = a[won], b[won], how[won]
        start, stop = stop, stop + len(won)
        made = np.arange(start, stop)
        waves.append(made)
        left[made], right[made], kind[made] = a, b, how
        up[a] = up[b] = made
        layer[made] = 1 + np.maximum(layer[a], layer[b])
        top[made], slot[made] = top[a], slot[a]
        low_end = np.select([how == 3, (how == 2) | (how == 5)], [bud[a], bud[b]], -1)
        span[made] = np.select([how == 2, how == 3, how == 5], [span[b], span[a], span[b] + span[a]], np.nan)
        hang[top[b], slot[b]] = -1
        hang[top[a], slot[a]] = made
        ended = (how == 4) | (how == 5)
        end[bud[a[ended]]] = -1
        bud[made] = low_end
        longer = low_end >= 0
        end[low_end[longer]] = made[longer]
    depth = np.zeros(total, np.int64)
    for made in reversed(waves):
        depth[left[made]] = depth[right[made]] = depth[made] + 1
    of = np.zeros(total, np.int64)
    of[:n] = tree[rows]
    for made in waves:
        of[made] = of[left[made]]
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    number = np.empty(total, np.int64)
    number[order] = np.arange(total) - np.repeat(first, np.diff(np.append(first, total)))
    single = order < n
    row = pa.array(np.where(single, rows[np.minimum(order, n - 1)], 0) if n else order, mask=~single)

    def comp(ids):
        return pa.array(number[ids[order]], mask=ids[order] < 0)

    return _table(block, wanted, {
        "tree_id": lambda: block.column("tree_id").take(pa.array(_first_rows(tree)[of[order]])),
        "comp_id": lambda: pa.array(number[order]), "left": lambda: comp(left), "right": lambda: comp(right),
        "parent": lambda: comp(up), "merge_type": lambda: pa.array(kind[order].astype(np.int32)),
        "is_clade": lambda: pa.array(bud[order] < 0), "layer": lambda: pa.array(layer[order].astype(np.int32)),
        "depth": lambda: pa.array(depth[order].astype(np.int32)),
        "span": lambda: pa.array(span[order], mask=np.isnan(span[order])),
    }, row)


def pruning_block(block: pa.Table, wanted: list[str]) -> pa.Table | None:
    """``wanted`` columns of the pruning plans; None where a tree is not binary."""
    edges = _Edges(block)
    if not edges.binary():
        return None
    tree, tip, up = edges.tree, edges.tip, edges.up
    rows = np.flatnonzero(edges.kept)
    rows = rows[np.lexsort((edges.post[rows], ~tip[rows], tree[rows]))]
    leaves = np.bincount(tree[rows[tip[rows]]], minlength=tree.max(initial=0) + 1)
    size = np.bincount(tree[rows], minlength=len(leaves))
    edge = np.zeros(len(tree), np.int64)  # leaves from 0, inner nodes behind them, the root last
    edge[rows] = np.arange(len(rows)) - (np.cumsum(size) - size)[tree[rows]]
    many = leaves[tree]
    node = np.where(tip, -1, 2 * many - 2 + 2 * (edge - many))
    full = np.where(tip, edge, node + 1)
    inner, stem = rows[~tip[rows]], rows[~tip[rows] & (up[rows] >= 0)]
    kids = edges.rows[np.lexsort((column(block, "child_ord")[edges.rows], up[edges.rows]))]
    young, old = np.full(len(tree), -1), np.full(len(tree), -1)
    young[up[kids[::2]]], old[up[kids[1::2]]] = full[kids[::2]], full[kids[1::2]]
    level = column(block, "depth").astype(np.int64)
    under = edges.rows
    e, j, s = len(under), len(inner), len(stem)
    none = np.full(e, -1)
    length = block.column("length").cast(pa.float64()).fill_null(np.nan).to_numpy()

    def parts(of_edges, of_joins, of_stems):
        return np.concatenate([of_edges, of_joins, of_stems])

    at = parts(under, inner, stem)
    comp_id = parts(edge[under], node[inner], full[stem])
    order = np.lexsort((comp_id, tree[at]))

    def comp(ids):
        return pa.array(ids[order], mask=ids[order] < 0)

    single = parts(np.ones(e, bool), np.zeros(j, bool), np.zeros(s, bool))[order]
    segment = single & ~tip[at[order]]
    span = np.where(segment, length[at[order]], np.nan)
    return _table(block, wanted, {
        "tree_id": lambda: block.column("tree_id").take(pa.array(at[order])),
        "comp_id": lambda: pa.array(comp_id[order]),
        "left": lambda: comp(parts(none, young[inner], edge[stem])),
        "right": lambda: comp(parts(none, old[inner], node[stem])),
        "parent": lambda: comp(parts(
            np.where(tip[under], node[up[under]], full[under]), np.where(up[inner] >= 0, full[inner], -1), node[up[stem]])),
        "merge_type": lambda: pa.array(np.repeat(np.array([0, 1, 4], np.int32), [e, j, s])[order]),
        "is_clade": lambda: pa.array(~segment), "layer": lambda: pa.nulls(len(at), pa.int32()),
        "depth": lambda: pa.array(parts(np.where(tip[under], 2 * level[under] - 1, 2 * level[under]), 2 * level[inner],
                                        2 * level[stem] - 1)[order].astype(np.int32)),
        "span": lambda: pa.array(span, mask=np.isnan(span)),
    }, pa.array(at[order], mask=~single))


def _first_rows(tree: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(tree, prepend=-1))


def _table(block: pa.Table, wanted: list[str], made: dict, row: pa.Array) -> pa.Table:
    """``wanted`` columns: made ones, or those of the node below an edge."""
    own = {"node_id": "node_id", "label": "label", "length": "length", "node_depth": "depth"}
    return pa.table({c: made[c]() if c in made else block.column(own[c]).take(row) for c in wanted})
