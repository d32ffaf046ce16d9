"""Metropolis-Hastings over branch lengths, on patterns of any number.

A chain draws the same numbers for iteration k whatever happened before, so
its trace does not depend on how the work is spread: each Spark job scores, per
chain, all states the next few iterations could reach, partition by partition;
only the sums come back.

Values of components are either built in each pass, or, for larger trees, kept in
written tables: a row per chain, component and block of patterns. A pass then reads
the components above the edges it tries, with their siblings, first brings up to
date those above edges accepted in the pass before, and writes only these.
"""

from __future__ import annotations

import copy
import math
import time
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import codes_of_strings
from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.operators.likelihood import (
    MAX_BROADCAST_COMPONENTS,
    PLAN_COLUMNS,
    TreePlan,
    load_plans,
    plan_with_taxa,
)
from cladeloom.plans import kernels
from cladeloom.session import discard, materialize, metric, spread

BLOCK_BYTES = 64 << 20
BYTES_PER_VALUE = 100  # a mix of 4- and 16-number components
KEEP_ABOVE = 2_048  # components of a tree from which reading a path beats building all of them
KEPT_SCHEMA = (
    "chain bigint, comp bigint, block bigint, form string, value binary, scale binary, history string, loglik double"
)

TRACE_SCHEMA = (
    "chain bigint, iteration bigint, branch bigint, old_length double, new_length double, "
    "accepted boolean, log_posterior double, seconds double"
)


@dataclass(frozen=True)
class MCMCOptions:
    """Exponential prior rate, proposal half-width, run length.

    ``proposal``: ``truncated`` draws from the window cut at 0 with a Hastings
    correction; ``symmetric`` draws from the whole window and rejects lengths
    that are not positive.
    """

    prior_rate: float = 20.0
    width: float = 0.01
    iterations: int = 1000
    chains: int = 1
    seed: int = 42
    proposal: str = "truncated"


class BranchUpdater:
    """All component values of one block of patterns, updated along one path."""

    def __init__(self, plan: TreePlan, codes: np.ndarray, freq: np.ndarray):
        self.plan, self.freq = plan, freq
        self.codes = np.ascontiguousarray(codes.T)
        self.value, self.scale = {}, {}
        for c in np.flatnonzero(plan.kind == 0).tolist():
            self.value[c], self.scale[c] = plan.edge(c, self.codes), 0
        self.root = plan.order[-1]
        for c in plan.order:
            self._merge(c)

    def _merge(self, c: int) -> None:
        p = self.plan
        a, b = int(p.left[c]), int(p.right[c])
        merged = kernels.merge(p.kind[c], self.value[a], self.value[b])
        self.value[c], self.scale[c] = kernels.rescale(merged, self.scale[a] + self.scale[b])

    def total(self) -> float:
        site = kernels.root_loglik(self.value[self.root], self.scale[self.root], self.plan.model.pi)
        return float(site @ self.freq)

    def change(self, comp: int, length: float) -> list:
        """Set one edge length, recompute its ancestors, return what was there."""
        matrix = self.plan.model.matrices(np.array([length]))[0]
        before = []
        c = comp
        while c >= 0:
            before.append((c, self.value[c], self.scale[c]))
            if c == comp:
                self.value[c] = self.plan.edge(c, self.codes, matrix)
            else:
                self._merge(c)
            c = int(self.plan.parent[c])
        return before

    def restore(self, before: list) -> None:
        for c, value, scale in before:
            self.value[c], self.scale[c] = value, scale


def log_prior(lengths: np.ndarray, rate: float) -> float:
    return len(lengths) * math.log(rate) - rate * float(np.sum(lengths))


def branch_components(plan: TreePlan) -> np.ndarray:
    """Edges in branch order: leaves by taxon, then inner edges in postorder."""
    edges = np.flatnonzero(plan.kind == 0)
    leaves = edges[plan.taxon[edges] >= 0]
    return np.concatenate([leaves[np.argsort(plan.taxon[leaves])], edges[plan.taxon[edges] < 0]])


class Chain:
    """Proposals and decisions of one chain, apart from the likelihood itself."""

    def __init__(self, chain: int, lengths: np.ndarray, loglik: float, options: MCMCOptions):
        self.options, self.chain = options, chain
        self.lengths, self.loglik = lengths.copy(), loglik
        self.prior = log_prior(lengths, options.prior_rate)
        rng = np.random.Generator(np.random.PCG64([options.seed, chain]))
        self.branches = rng.integers(len(lengths), size=options.iterations)
        self.steps = rng.random(options.iterations)
        self.tests = rng.random(options.iterations)
        self.rows = []

    def propose(self, k: int, lengths: np.ndarray) -> tuple[int, float, float]:
        branch, w = int(self.branches[k]), self.options.width
        old = float(lengths[branch])
        low = old - w if self.options.proposal == "symmetric" else max(0.0, old - w)
        return branch, old, low + (old + w - low) * float(self.steps[k])

    def decide(self, k: int, loglik: float | None, seconds: float) -> bool:
        branch, old, new = self.propose(k, self.lengths)
        accept = False
        if loglik is not None:
            prior = self.prior + self.options.prior_rate * (old - new)
            ratio = loglik + prior - self.loglik - self.prior
            if self.options.proposal != "symmetric":
                w = self.options.width
                ratio += math.log(old + w - max(old - w, 0.0))
                ratio -= math.log(new + w - max(new - w, 0.0))
            accept = math.log(self.tests[k]) < ratio if self.tests[k] > 0 else True
            if accept:
                self.loglik, self.prior = loglik, prior
                self.lengths[branch] = new
        self.rows.append(
            (self.chain, k, branch, old, new, accept, self.loglik + self.prior, seconds)
        )
        return accept

    def without_trace(self) -> Chain:
        """What a task needs: lengths and draws, not the rows written so far."""
        bare = copy.copy(self)
        bare.rows = []
        return bare

    def needs_score(self, new: float) -> bool:
        return new > 0.0 or self.options.proposal != "symmetric"


def run_mcmc(
    patterns: DataFrame,
    plan: DataFrame,
    taxa: DataFrame,
    options: MCMCOptions | None = None,
    model: SubstitutionModel | None = None,
    lookahead: int = 4,
    keep: bool | None = None,
) -> DataFrame:
    """Trace of every chain, started from the tree's own branch lengths.

    ``plan`` holds one tree; its layout (balanced or pruning) sets how many
    components one update touches, not the trace. ``lookahead`` iterations share
    a job; fewer jobs cost up to 2 ** ``lookahead`` updates each. ``keep`` tells
    whether component values are kept between passes; unless given, they are for
    trees of more than ``KEEP_ABOVE`` components. The trace is the same.
    """
    options, model = options or MCMCOptions(), model or JukesCantor()
    placed = materialize(plan_with_taxa(plan, taxa).select(*PLAN_COLUMNS), "plan")
    if metric(placed) > MAX_BROADCAST_COMPONENTS:
        raise ValueError("the tree is too large to update inside one task")
    trees = load_plans(placed, model)
    if len(trees) != 1:
        raise ValueError("run_mcmc takes the plan of exactly one tree")
    (tree,) = trees.values()
    if metric(placed) > KEEP_ABOVE if keep is None else keep:
        scores = KeptValues(patterns, tree).score
    else:
        dealt = spread(patterns.select("pattern_id", "pattern", "freq"), "pattern_id")
        scores = partial(_score, materialize(dealt, "patterns"), tree, branch_components(tree))
    return _shared_passes(patterns.sparkSession, scores, tree, options, lookahead)


def _trace_columns() -> list[str]:
    return [c.split()[0] for c in TRACE_SCHEMA.split(", ")]


def _shared_passes(spark, scores_of, tree: TreePlan, options: MCMCOptions, lookahead: int) -> DataFrame:
    """One pass per ``lookahead`` iterations of all chains, by ``scores_of(chains, k, steps)``.

    The driver keeps lengths and decisions, a few numbers per chain. Outcomes
    are named by their accept/reject history, e.g. '' , 'a', 'r', 'ar'.
    """
    start = tree.lengths[branch_components(tree)]
    first = scores_of([Chain(0, start, 0.0, options)], 0, 0)
    chains = [Chain(c, start, first[0, "start"], options) for c in range(options.chains)]
    for k in range(0, options.iterations, lookahead):
        steps = min(lookahead, options.iterations - k)
        t0 = time.perf_counter()
        scores = scores_of(chains, k, steps)
        seconds = (time.perf_counter() - t0) / steps
        for chain in chains:
            history = ""
            for j in range(steps):
                accepted = chain.decide(k + j, scores.get((chain.chain, history)), seconds)
                history += "a" if accepted else "r"
    rows = [r for c in chains for r in c.rows]
    return spark.createDataFrame(pd.DataFrame(rows, columns=_trace_columns()), TRACE_SCHEMA)


def _explore(work, chain: Chain, comps, lengths, at: int, end: int, history: str, out: dict) -> None:
    """Add the total of every proposal reachable in iterations ``at`` to ``end`` to ``out``."""
    if at == end:
        return
    branch, old, new = chain.propose(at, lengths)
    if chain.needs_score(new):
        before = work.change(int(comps[branch]), new)
        out[chain.chain, history] = out.get((chain.chain, history), 0.0) + work.total()
        lengths[branch] = new
        _explore(work, chain, comps, lengths, at + 1, end, history + "a", out)
        work.restore(before)
        lengths[branch] = old
    _explore(work, chain, comps, lengths, at + 1, end, history + "r", out)


def _score(patterns, tree, comps, chains, k: int, steps: int) -> dict:
    """Summed log-likelihoods of every reachable proposal, keyed by chain and history."""
    bare = [c.without_trace() for c in chains]
    shared = patterns.sparkSession.sparkContext.broadcast((tree, comps, bare))
    rows_per_block = max(64, BLOCK_BYTES // (len(tree.kind) * BYTES_PER_VALUE))

    def run(batches):
        plan, edges, states = shared.value
        out = {}
        for pdf in batches:
            codes = codes_of_strings(pdf["pattern"].tolist())
            freq = pdf["freq"].to_numpy(float)
            for s in range(0, len(pdf), rows_per_block):
                part = slice(s, s + rows_per_block)
                for chain in states:
                    current = plan.lengths.copy()
                    current[edges] = chain.lengths
                    plan.set_lengths(current)
                    work = BranchUpdater(plan, codes[part], freq[part])
                    if steps == 0:
                        key = chain.chain, "start"
                        out[key] = out.get(key, 0.0) + work.total()
                    _explore(work, chain, edges, chain.lengths.copy(), k, k + steps, "", out)
        if out:
            yield pd.DataFrame(
                [(c, h, v) for (c, h), v in out.items()], columns=["chain", "history", "value"]
            )

    sums = (
        patterns.select("pattern", "freq")
        .mapInPandas(run, "chain bigint, history string, value double")
        .groupBy("chain", "history").agg(F.sum("value").alias("value"))
    )
    found = {(r.chain, r.history): r.value for r in sums.collect()}
    shared.unpersist()
    return found


class PathUpdater(BranchUpdater):
    """The values one pass needs of a block, read instead of built; ``codes`` by taxon."""

    def __init__(self, plan: TreePlan, codes: dict, freq: np.ndarray, stored: dict, lengths: dict):
        self.plan, self.freq, self.codes = plan, freq, codes
        self.root = plan.order[-1]
        self.value = {c: v for c, (v, _) in stored.items()}
        self.scale = {c: s for c, (_, s) in stored.items()}
        for c, matrix in zip(lengths, plan.model.matrices(np.array(list(lengths.values())))):
            self.value[c], self.scale[c] = plan.edge(c, codes, matrix), 0


class KeptValues:
    """Versions of component values in written tables, and which of them is current.

    The driver knows, per chain and component, the table with its last version; what
    chains have in common since the start is there once, under chain -1. Tables
    without a current version are deleted. ``touched`` lists how many components each
    chain had brought up to date in each pass.
    """

    def __init__(self, patterns: DataFrame, tree: TreePlan, rows_per_block: int | None = None):
        self.tree, self.comps = tree, branch_components(tree)
        self.place = {int(c): at for at, c in enumerate(self.comps)}
        rows_per_block = rows_per_block or max(64, BLOCK_BYTES // (len(tree.kind) * BYTES_PER_VALUE))
        kept = materialize(patterns.select("pattern_id", "pattern", "freq"), "patterns")
        blocks = max(1, -(-metric(kept) // rows_per_block))
        block = F.pmod(F.xxhash64("pattern_id"), F.lit(blocks)).alias("block")
        shared = patterns.sparkSession.sparkContext.broadcast(tree)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_built(shared.value, pdf), columns=_kept_columns())

        laid = spread(kept.select(block, "pattern", "freq"), "block").groupBy("block").applyInPandas(build, KEPT_SCHEMA)
        self.tables = {-1: materialize(laid.sortWithinPartitions("comp"), "kept_values")}
        self.version: dict[tuple[int, int], int] = {}
        self.lengths: dict[int, np.ndarray] = {}
        self.touched: list[dict[int, int]] = []

    def _above(self, edges) -> set[int]:
        found = set()
        for c in edges:
            c = int(self.tree.parent[c])
            while c >= 0 and c not in found:
                found.add(c)
                c = int(self.tree.parent[c])
        return found

    def _wanted(self, chain: int, merges: set[int], edges: set[int]) -> tuple[dict, set[int]]:
        """Components to read by table, and the edges whose values are made from lengths."""
        tree, by_table = self.tree, {-1: {(-1, -1)}}
        ends = {int(c) for m in merges for c in (tree.left[m], tree.right[m])} | merges | edges
        for c in ends:
            if tree.kind[c]:
                at = self.version.get((chain, c), -1)
                by_table.setdefault(at, set()).add((chain if at >= 0 else -1, c))
            elif tree.taxon[c] >= 0:
                by_table[-1].add((-1, c))
        return by_table, {c for c in ends if not tree.kind[c]}

    def score(self, chains: list[Chain], k: int, steps: int) -> dict:
        if not steps:
            return self._sums(self.tables[-1])
        work, wanted = [], {}
        for chain in chains:
            before = self.lengths.get(chain.chain, self.tree.lengths[self.comps])
            stale = self._above(self.comps[np.flatnonzero(chain.lengths != before)])
            tried = {int(self.comps[b]) for b in chain.branches[k:k + steps]}
            by_table, edges = self._wanted(chain.chain, stale | self._above(tried), tried)
            for table, rows in by_table.items():
                wanted.setdefault(table, set()).update(rows)
            read = {(c, n) for rows in by_table.values() for c, n in rows}
            work.append((chain.without_trace(), sorted(stale), sorted(edges), read))
            self.lengths[chain.chain] = chain.lengths.copy()
        self.touched.append({chain.chain: len(stale) for chain, stale, _, _ in work})
        rows = None
        for table, pairs in wanted.items():
            some = self.tables[table].filter("history IS NULL")
            held = F.lit(False)
            for c in {c for c, _ in pairs}:
                held = held | (F.col("chain") == c) & F.col("comp").isin(sorted(n for d, n in pairs if d == c))
            some = some.filter(held).select("chain", "comp", "block", "form", "value", "scale")
            rows = some if rows is None else rows.unionByName(some)
        shared = rows.sparkSession.sparkContext.broadcast((self.tree, self.comps, self.place, work))

        def update(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_updated(*shared.value, pdf, k, k + steps), columns=_kept_columns())

        done = spread(rows, "block").groupBy("block").applyInPandas(update, KEPT_SCHEMA)
        self.tables[k] = materialize(done, "kept_values")
        shared.unpersist()
        for chain, stale, _, _ in work:
            self.version.update({(chain.chain, c): k for c in stale})
        sums = self._sums(self.tables[k])
        for old in set(self.tables) - {-1} - set(self.version.values()):
            discard(self.tables.pop(old))
        return sums

    def _sums(self, table: DataFrame) -> dict:
        sums = table.filter("history IS NOT NULL").groupBy("chain", "history").agg(F.sum("loglik").alias("value"))
        return {(r.chain, r.history): r.value for r in sums.collect()}


def _kept_columns() -> list[str]:
    return [c.split()[0] for c in KEPT_SCHEMA.split(", ")]


def _kept_row(chain: int, comp: int, block: int, value: np.ndarray, scale) -> tuple:
    form = " ".join(map(str, value.shape))
    return chain, comp, block, form, value.tobytes(), np.asarray(scale, np.int64).tobytes(), None, None


def _built(plan: TreePlan, pdf: pd.DataFrame):
    """Frequencies (component -1), codes of leaf edges and values of merges of one block."""
    block = int(pdf["block"].iloc[0])
    work = BranchUpdater(plan, codes_of_strings(pdf["pattern"].tolist()), pdf["freq"].to_numpy(float))
    yield _kept_row(-1, -1, block, work.freq, 0)
    for c in np.flatnonzero((plan.kind == 0) & (plan.taxon >= 0)).tolist():
        yield _kept_row(-1, c, block, work.codes[plan.taxon[c]].astype(np.uint8), 0)
    for c in plan.order:
        yield _kept_row(-1, c, block, work.value[c], work.scale[c])
    yield 0, None, block, None, None, None, "start", work.total()


def _updated(plan: TreePlan, comps, place, work, pdf: pd.DataFrame, k: int, end: int):
    """New versions of stale components of one block, and sums of what the chains try."""
    block, stored, codes, freq = int(pdf["block"].iloc[0]), {}, {}, None
    for row in pdf.itertuples():
        if row.comp < 0:
            freq = np.frombuffer(row.value)
        elif plan.kind[row.comp]:
            scale = np.frombuffer(row.scale, np.int64)
            value = np.frombuffer(row.value).reshape([int(n) for n in row.form.split()])
            stored[row.chain, row.comp] = value, scale if len(scale) > 1 else int(scale[0])
        else:
            codes[int(plan.taxon[row.comp])] = np.frombuffer(row.value, np.uint8)
    for chain, stale, edges, read in work:
        mine = {n: stored[c, n] for c, n in read if (c, n) in stored}
        updater = PathUpdater(plan, codes, freq, mine, {c: chain.lengths[place[c]] for c in edges})
        todo = set(stale)
        for c in plan.order if todo else ():
            if c in todo:
                updater._merge(c)
                yield _kept_row(chain.chain, c, block, updater.value[c], updater.scale[c])
        out: dict = {}
        _explore(updater, chain, comps, chain.lengths.copy(), k, end, "", out)
        for (number, history), value in out.items():
            yield number, None, block, None, None, None, history, value


def prior_of_trees(nodes: DataFrame, rate: float) -> DataFrame:
    """(tree_id, log_prior): sum of ln(rate) - rate * length over the edges."""
    edges = nodes.filter("parent_id is not null")
    return edges.groupBy("tree_id").agg(
        F.sum(F.lit(math.log(rate)) - rate * F.col("length")).alias("log_prior")
    )


def branch_updates(
    patterns: DataFrame, plan: DataFrame, taxa: DataFrame, new_lengths: DataFrame,
    model: SubstitutionModel | None = None, total: bool = True,
) -> DataFrame:
    """(comp_id, loglik) of a tree after changing one edge at a time.

    ``new_lengths``: (comp_id, new_length), at most one length an edge. Only the
    merges above the changed edge are recomputed, in either layout of the plan.
    Without ``total``: one row per edge and pattern, with pattern_id and freq.
    """
    placed = materialize(plan_with_taxa(plan, taxa).select(*PLAN_COLUMNS), "plan")
    lengths = materialize(new_lengths.select("comp_id", "new_length"), "new_lengths")
    if max(metric(placed), metric(lengths)) > MAX_BROADCAST_COMPONENTS:
        raise ValueError("the tree is too large to update inside one task")
    (tree,) = load_plans(placed, model or JukesCantor()).values()
    changes = [(r.comp_id, r.new_length) for r in lengths.orderBy("comp_id").collect()]
    shared = patterns.sparkSession.sparkContext.broadcast((tree, changes))
    rows_per_block = max(64, BLOCK_BYTES // (len(tree.kind) * BYTES_PER_VALUE))

    def run(batches):
        plan, edges = shared.value
        for pdf in batches:
            for s in range(0, len(pdf), rows_per_block):
                part = pdf.iloc[s : s + rows_per_block]
                codes = codes_of_strings(part["pattern"].tolist())
                work = BranchUpdater(plan, codes, part["freq"].to_numpy(float))
                sums = []
                for comp, length in edges:
                    before = work.change(comp, length)
                    if total:
                        sums.append((comp, work.total()))
                    else:
                        site = kernels.root_loglik(
                            work.value[work.root], work.scale[work.root], plan.model.pi
                        )
                        yield pd.DataFrame(
                            {"comp_id": comp, "pattern_id": part["pattern_id"],
                             "freq": part["freq"], "loglik": site}
                        )
                    work.restore(before)
                if total:
                    yield pd.DataFrame(sums, columns=["comp_id", "loglik"])

    dealt = spread(patterns.select("pattern_id", "pattern", "freq"), "pattern_id")
    if total:
        parts = dealt.mapInPandas(run, "comp_id bigint, loglik double")
        return parts.groupBy("comp_id").agg(F.sum("loglik").alias("loglik"))
    return dealt.mapInPandas(run, "comp_id bigint, pattern_id bigint, freq bigint, loglik double")
