"""Golden likelihoods by enumeration over internal states, and path equality."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.functions.codes import SYMBOLS, state_matrix
from cladeloom.functions.models import HKY85, JukesCantor
from cladeloom.operators import likelihood
from cladeloom.operators.layered import layered_loglik
from cladeloom.operators.likelihood import (
    PLAN_COLUMNS,
    joined_loglik,
    load_plans,
    pattern_loglik,
    plan_with_taxa,
    tree_loglik,
)
from cladeloom.operators.mcmc import KeptValues, MCMCOptions, _shared_passes, branch_updates, run_mcmc
from cladeloom.operators.pruning import pattern_cells
from cladeloom.operators.subpatterns import component_taxa, consed_loglik
from cladeloom.operators.simulate import simulate_sequences, simulate_trees
from cladeloom.operators.trees import resolve
from cladeloom.plans import kernels
from cladeloom.plans.decomposition import decompose, plan_heights, pruning_heights
from cladeloom.session import materialize
from cladeloom.sources.newick import parse_newick

BAL = "((A:0.1,B:0.2):0.05,(C:0.3,D:0.15):0.25);"
CAT = "(A:0.1,(B:0.2,(C:0.3,D:0.15):0.25):0.05);"
CAT5 = "(A:0.1,(B:0.2,(C:0.3,(D:0.15,E:0.25):0.12):0.08):0.05);"
MIX5 = "(((A:0.1,B:0.2):0.12,(C:0.3,D:0.15):0.08):0.05,E:0.25);"
TREES = [BAL, CAT, CAT5, MIX5]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = list(enumerate(TREES))
    return materialize(parse_newick(spark.createDataFrame(rows, "tree_id bigint, newick string")))


@pytest.fixture(scope="module")
def taxa(spark):
    return spark.createDataFrame(list(enumerate("ABCDE")), "taxon_id bigint, taxon string")


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [(0, "0000e", 5), (1, "0011e", 2), (2, "0202e", 1), (3, "34e1e", 2)]
    return spark.createDataFrame(rows, "pattern_id bigint, pattern string, freq bigint")


@pytest.fixture(scope="module")
def patterns5(spark):
    rows = [(0, "00000", 1), (1, "01230", 1), (2, "4e231", 1), (3, "eeeee", 2)]
    return spark.createDataFrame(rows, "pattern_id bigint, pattern string, freq bigint")


GOLDEN = {
    0: [-2.38909525556177, -4.516176239637815, -7.125797530329343, -5.268860810378322],
    1: [-2.3920197198426068, -4.685037389287298, -6.932620621660284, -5.185906893613171],
}
GOLDEN5 = {
    2: [-2.589725266342248, -9.905675765431097, -6.547528493945946, 0.0],
    3: [-2.587021920995736, -9.58001385779519, -6.870315393251698, 0.0],
}


def _check(df, golden):
    got = {(r.tree_id, r.pattern_id): r.loglik for r in df.collect()}
    assert len(got) == sum(map(len, golden.values()))
    for tree, values in golden.items():
        for k, v in enumerate(values):
            assert got[tree, k] == pytest.approx(v, abs=1e-11)


@pytest.mark.parametrize("layout", ["balanced", "pruning", "greedy"])
@pytest.mark.parametrize("strategy", ["blocks", "grid"])
def test_golden_plans(nodes, taxa, patterns, patterns5, layout, strategy):
    plan = materialize(decompose(nodes, layout))
    small = dict(strategy=strategy, chunk_components=10, block_cells=8)
    _check(pattern_loglik(patterns, plan.filter("tree_id < 2"), taxa, **small), GOLDEN)
    _check(pattern_loglik(patterns5, plan.filter("tree_id >= 2"), taxa, **small), GOLDEN5)


def test_golden_joins(nodes, taxa, patterns, patterns5):
    _check(joined_loglik(patterns, nodes.filter("tree_id < 2"), taxa), GOLDEN)
    _check(joined_loglik(patterns5, nodes.filter("tree_id >= 2"), taxa), GOLDEN5)


def test_golden_layers(nodes, taxa, patterns, patterns5):
    plan = materialize(decompose(nodes))
    cells, cells5 = pattern_cells(patterns, taxa), pattern_cells(patterns5, taxa)
    _check(layered_loglik(cells, plan.filter("tree_id < 2")), GOLDEN)
    _check(layered_loglik(cells5, plan.filter("tree_id >= 2")), GOLDEN5)


def test_layers_equal_blocks_on_a_sparse_caterpillar(spark):
    n = 40
    tree = materialize(simulate_trees(spark.createDataFrame([(0, n)], "tree_id bigint, n_taxa int"),
                                      "caterpillar"))
    taxa = spark.createDataFrame([(k, f"T{k}") for k in range(n)], "taxon_id bigint, taxon string")
    rng = np.random.default_rng(6)
    rows = [(k, "".join(rng.choice(list("0123eeee4"), n)), 1) for k in range(20)]
    patterns = spark.createDataFrame(rows, "pattern_id bigint, pattern string, freq bigint")
    plan, model = materialize(decompose(tree)), HKY85(3.0, (0.1, 0.2, 0.3, 0.4))
    want = {r.pattern_id: r.loglik for r in pattern_loglik(patterns, plan, taxa, model).collect()}
    got = layered_loglik(pattern_cells(patterns, taxa), plan, model).collect()
    assert {r.pattern_id: r.loglik for r in got} == pytest.approx(want, abs=1e-9)


def test_score_nodes_without_task_sized_trees(nodes, taxa, patterns, monkeypatch):
    two = nodes.filter("tree_id < 2")
    for rounds in (40, 1):
        monkeypatch.setattr(likelihood, "GRID_CHUNK_COMPONENTS", 0)
        monkeypatch.setattr(likelihood, "MAX_PRUNING_ROUNDS", rounds)
        got = {r.tree_id: r.loglik for r in likelihood.score_nodes(patterns, two, taxa).collect()}
        assert got == pytest.approx({0: -38.64134790817047, 1: -38.63460778667425}, abs=1e-10)


@pytest.mark.parametrize("cells, rounds", [(200_000, 40), (0, 40), (0, 1)])
def test_one_answer_at_every_size(spark, monkeypatch, cells, rounds):
    """Unary nodes, a tree of one leaf, and patterns without data in a tree, by all ways."""
    texts = ["(((A:0.1,B:0.2):0.1):0.5,C:0.3);", "(A:0.1,B:0.2);", "(C:0.4);"]
    trees = parse_newick(spark.createDataFrame(list(enumerate(texts)), "tree_id bigint, newick string"))
    taxa = spark.createDataFrame([(k, t) for k, t in enumerate("ABCD")], "taxon_id bigint, taxon string")
    rows = [(0, "0000", 2), (1, "0123", 1), (2, "eee1", 3), (3, "01ee", 1)]
    patterns = spark.createDataFrame(rows, "pattern_id bigint, pattern string, freq bigint")
    plan = decompose(resolve(trees.filter("tree_id < 2")))
    want = {r.tree_id: r.loglik for r in tree_loglik(patterns, plan, taxa).collect()}
    want[2] = 3 * np.log(0.25)  # C has data in three sites
    monkeypatch.setattr(likelihood, "GRID_CHUNK_COMPONENTS", cells)
    monkeypatch.setattr(likelihood, "MAX_PRUNING_ROUNDS", rounds)
    got = {r.tree_id: r.loglik for r in likelihood.score_nodes(patterns, trees, taxa).collect()}
    assert got == pytest.approx(want, abs=1e-10)
    with pytest.raises(ValueError, match="taxon D in tree"):
        likelihood.score_nodes(patterns, parse_newick(spark.createDataFrame(
            [(0, "(A:0.1,D:0.2);")], "tree_id bigint, newick string")), taxa.filter("taxon <> 'D'"))


def test_totals(nodes, taxa, patterns):
    plan = decompose(nodes.filter("tree_id < 2"))
    got = {r.tree_id: r.loglik for r in tree_loglik(patterns, plan, taxa).collect()}
    assert got[0] == pytest.approx(-38.64134790817047, abs=1e-10)
    assert got[1] == pytest.approx(-38.63460778667425, abs=1e-10)


MERGES = {
    0: {6: (1, 0, 1, 1), 7: (3, 2, 1, 1), 8: (4, 6, 4, 2), 9: (5, 7, 4, 2), 10: (9, 8, 1, 3)},
    1: {6: (3, 2, 1, 1), 7: (1, 4, 2, 1), 8: (0, 5, 2, 1), 9: (7, 6, 4, 2), 10: (8, 9, 4, 3)},
    2: {8: (4, 3, 1, 1), 9: (2, 5, 2, 1), 10: (1, 6, 2, 1), 11: (0, 7, 2, 1), 12: (9, 8, 4, 2),
        13: (11, 10, 5, 2), 14: (13, 12, 4, 3)},
    3: {8: (1, 0, 1, 1), 9: (3, 2, 1, 1), 10: (4, 7, 2, 1), 11: (5, 8, 4, 2), 12: (6, 9, 4, 2),
        13: (10, 11, 3, 3), 14: (13, 12, 4, 4)},
}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decomposition_traces(nodes, limit):
    """Hand traces of the merge rule, by the one-task planner and by joins."""
    rows = decompose(nodes, max_grouped_nodes=limit).filter("merge_type > 0").collect()
    got = {t: {} for t in MERGES}
    for r in rows:
        got[r.tree_id][r.comp_id] = (r.left, r.right, r.merge_type, r.layer)
        assert r.is_clade == (r.merge_type in (1, 4))
    assert got == MERGES


def test_heights(nodes):
    balanced = {r.tree_id: (r.height, r.avg_height) for r in plan_heights(decompose(nodes)).collect()}
    pruning = {
        r.tree_id: (r.pruning_height, r.pruning_avg_height)
        for r in pruning_heights(nodes).collect()
    }
    assert balanced == {0: (3, 16 / 6), 1: (3, 16 / 6), 2: (3, 3.0), 3: (4, 25 / 8)}
    assert pruning == {0: (3, 16 / 6), 1: (5, 20 / 6), 2: (7, 35 / 8), 3: (5, 31 / 8)}
    layout = {r.tree_id: (r.height, r.avg_height)
              for r in plan_heights(decompose(nodes, "pruning")).collect()}
    assert layout == pruning


def _enumerate(newick_children, lengths, pattern, model):
    """Sum over all internal states; ``newick_children`` maps node to children."""
    inner = [v for v in newick_children if newick_children[v]]
    sets = state_matrix()
    total = 0.0
    for states in itertools.product(range(4), repeat=len(inner)):
        at = dict(zip(inner, states))
        p = model.pi[at["root"]]
        for v in inner:
            for c in newick_children[v]:
                row = model.matrices(np.array([lengths[c]]))[0][at[v]]
                p *= row[at[c]] if c in at else row @ sets[SYMBOLS.index(pattern["ABCD".index(c)])]
        total += p
    return math.log(total)


@pytest.mark.parametrize("model", [JukesCantor(), HKY85(2.0, (0.3, 0.2, 0.2, 0.3))])
def test_enumeration(spark, nodes, taxa, model):
    rows = [(k, "".join(p) + "e", 1) for k, p in enumerate(itertools.product("0134e", repeat=4))]
    patterns = spark.createDataFrame(rows[::7], "pattern_id bigint, pattern string, freq bigint")
    one = nodes.filter("tree_id = 1")
    children = {"root": ["A", "x"], "x": ["B", "y"], "y": ["C", "D"], "A": [], "B": [], "C": [], "D": []}
    lengths = {"A": 0.1, "x": 0.05, "B": 0.2, "y": 0.25, "C": 0.3, "D": 0.15}
    want = {r[0]: _enumerate(children, lengths, r[1], model) for r in rows[::7]}
    for df in (pattern_loglik(patterns, decompose(one), taxa, model),
               joined_loglik(patterns, one, taxa, model)):
        got = {r.pattern_id: r.loglik for r in df.collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-10)


def test_polytomy_and_resolution_agree(spark, taxa, patterns5):
    text = "(A:0.1,(B:0.2):0.4,C:0.3,(D:0.15,E:0.1):0.2);"
    tree = materialize(parse_newick(spark.createDataFrame([(0, text)], "tree_id bigint, newick string")))
    flat = "(A:0.1,B:0.2,C:0.3,(D:0.15,E:0.1):0.2);"
    bare = parse_newick(spark.createDataFrame([(0, flat)], "tree_id bigint, newick string"))
    want = {r.pattern_id: r.loglik for r in joined_loglik(patterns5, bare, taxa).collect()}
    plan = decompose(resolve(tree))
    got = {r.pattern_id: r.loglik for r in pattern_loglik(patterns5, plan, taxa).collect()}
    assert got == pytest.approx(want, abs=1e-10)


def test_unknown_taxon_fails_and_absent_taxon_is_ignored(spark, nodes, taxa, patterns, patterns5):
    plan = decompose(nodes.filter("tree_id = 2"))
    with pytest.raises(Exception, match="not in the alignment"):
        pattern_loglik(patterns, plan, taxa.filter("taxon <> 'E'")).collect()
    four = decompose(nodes.filter("tree_id = 0"))
    a = tree_loglik(patterns, four, taxa).first().loglik
    b = tree_loglik(patterns.withColumn("pattern", F.concat(F.substring("pattern", 1, 4), F.lit("0"))),
                    four, taxa).first().loglik
    assert a == pytest.approx(b, abs=1e-12)


def test_deep_caterpillar_does_not_underflow(spark):
    n = 3000
    reps = spark.createDataFrame([(0, n)], "tree_id bigint, n_taxa int")
    tree = materialize(simulate_trees(reps, "caterpillar"))
    taxa = spark.createDataFrame([(k, f"T{k}") for k in range(n)], "taxon_id bigint, taxon string")
    rng = np.random.default_rng(1)
    rows = [(k, "".join(SYMBOLS[c] for c in rng.integers(0, 4, n)), 1) for k in range(3)]
    patterns = spark.createDataFrame(rows, "pattern_id bigint, pattern string, freq bigint")
    values = [
        tree_loglik(patterns, decompose(tree, layout), taxa).first().loglik
        for layout in ("balanced", "pruning")
    ]
    assert all(map(math.isfinite, values)) and values[0] < -3000
    assert values[0] == pytest.approx(values[1], rel=1e-10)


@pytest.mark.parametrize("proposal", ["truncated", "symmetric"])
def test_mcmc_same_trace_everywhere(nodes, taxa, patterns5, proposal):
    """Neither the layout nor the number of iterations a job changes the chains."""
    one = nodes.filter("tree_id = 3")
    options = MCMCOptions(width=0.2, iterations=12, chains=2, seed=5, proposal=proposal)
    traces = []
    for layout, lookahead, keep in (("balanced", 1, False), ("pruning", 5, True), ("balanced", 3, True)):
        trace = run_mcmc(patterns5, decompose(one, layout), taxa, options, lookahead=lookahead, keep=keep)
        traces.append(trace.orderBy("chain", "iteration").collect())
    first = traces[0]
    assert len(first) == 24 and len({r.accepted for r in first}) == 2
    for other in traces[1:]:
        for a, b in zip(first, other):
            assert (a.chain, a.iteration, a.branch, a.accepted) == (
                b.chain, b.iteration, b.branch, b.accepted)
            assert a.log_posterior == pytest.approx(b.log_posterior, abs=1e-9)
            assert a.new_length == pytest.approx(b.new_length, abs=1e-12)


def test_kept_values_touch_paths_only(spark):
    """A caterpillar of 200 leaves in the balanced layout: what a pass brings up to date is a path an acceptance."""
    newick = "A0:0.1"
    for i in range(1, 200):
        newick = f"({newick},A{i}:0.2):0.1"
    nodes = parse_newick(spark.createDataFrame([(0, newick + ";")], "tree_id bigint, newick string"))
    taxa = spark.createDataFrame([(i, f"A{i}") for i in range(200)], "taxon_id bigint, taxon string")
    patterns = spark.createDataFrame(
        [(k, "".join("0123"[(i * (k + 3) + k) % 4] for i in range(200)), k + 1) for k in range(7)],
        "pattern_id bigint, pattern string, freq bigint")
    plan = materialize(decompose(nodes, "balanced"))
    placed = plan_with_taxa(plan, taxa).select(*PLAN_COLUMNS)
    (tree,) = load_plans(placed, JukesCantor()).values()
    kept = KeptValues(patterns, tree, rows_per_block=3)
    steps, options = 2, MCMCOptions(width=0.2, iterations=6, chains=2, seed=5)
    trace = _shared_passes(spark, kept.score, tree, options, steps).orderBy("chain", "iteration").collect()
    plain = run_mcmc(patterns, plan, taxa, options, lookahead=steps, keep=False).orderBy("chain", "iteration").collect()
    for a, b in zip(trace, plain, strict=True):
        assert (a.chain, a.branch, a.accepted) == (b.chain, b.branch, b.accepted)
        assert a.log_posterior == pytest.approx(b.log_posterior, abs=1e-8)
    height = max(len(kept._above([c])) for c in kept.comps)
    assert height < 40 and len(tree.order) > 390
    accepted = {(r.chain, r.iteration // steps) for r in trace if r.accepted}
    assert accepted
    for at, touched in enumerate(kept.touched):
        for chain, count in touched.items():
            assert count <= steps * height
            assert (count > 0) == ((chain, at - 1) in accepted)


@pytest.mark.parametrize("layout", ["balanced", "pruning"])
def test_branch_update_equals_full_evaluation(spark, nodes, taxa, patterns5, layout):
    plan = materialize(decompose(nodes.filter("tree_id = 2"), layout))
    longer = spark.createDataFrame([(6, 0.5)], "comp_id bigint, new_length double")
    updated = branch_updates(patterns5, plan, taxa, longer, total=False)
    changed = plan.withColumn("length", F.when(F.col("comp_id") == 6, 0.5).otherwise(F.col("length")))
    want = {r.pattern_id: r.loglik for r in pattern_loglik(patterns5, changed, taxa).collect()}
    got = {r.pattern_id: r.loglik for r in updated.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    (total,) = branch_updates(patterns5, plan, taxa, longer).collect()
    freq = {r.pattern_id: r.freq for r in patterns5.collect()}
    assert total.comp_id == 6
    assert total.loglik == pytest.approx(sum(freq[k] * v for k, v in want.items()), abs=1e-11)


def test_shared_subpatterns_equal_full_evaluation(nodes, taxa, patterns, patterns5):
    plan = materialize(decompose(nodes))
    _check(pattern_loglik(patterns, plan.filter("tree_id < 2"), taxa, reuse=True), GOLDEN)
    small = dict(strategy="grid", chunk_components=10, block_cells=8, reuse=True)
    _check(pattern_loglik(patterns5, plan.filter("tree_id >= 2"), taxa, **small), GOLDEN5)
    tree = load_plans(plan_with_taxa(plan.filter("tree_id = 3"), taxa), JukesCantor())[3]
    codes = np.random.default_rng(3).integers(0, 4, (20_000, 5))
    values, merged = tree.loglik_shared(codes)
    assert np.allclose(values, tree.loglik(codes), rtol=0, atol=1e-12)
    assert merged < len(codes) * len(tree.order) / 10


def test_kernels_against_plain_loops():
    rng = np.random.default_rng(0)
    P = 3
    a, b = rng.random((4, P)), rng.random((4, P))
    A, B = rng.random((4, 4, P)), rng.random((4, 4, 1))
    for p in range(P):
        Bp = B[:, :, 0]
        assert np.allclose(kernels.merge(1, a, b)[:, p], a[:, p] * b[:, p])
        assert np.allclose(kernels.merge(2, a, B)[:, :, p], np.diag(a[:, p]) @ Bp)
        assert np.allclose(kernels.merge(3, B, b)[:, :, p], Bp @ np.diag(b[:, p]))
        assert np.allclose(kernels.merge(4, A, b)[:, p], A[:, :, p] @ b[:, p])
        assert np.allclose(kernels.merge(5, A, B)[:, :, p], A[:, :, p] @ Bp)
    tiny, scale = kernels.rescale(a * 2.0**-100, 0)
    assert np.allclose(np.ldexp(tiny, scale), a * 2.0**-100, rtol=0, atol=0)


def test_models():
    jc = JukesCantor().matrices(np.array([0.1]))[0]
    assert jc[0, 0] == pytest.approx(0.9063799892822106, abs=1e-15)
    hky = HKY85(2.0, (0.3, 0.2, 0.2, 0.3))
    one, two, three = hky.matrices(np.array([0.1, 0.2, 0.3]))
    assert one[0] == pytest.approx([0.914128682, 0.019401461, 0.037367665, 0.029102192], abs=1e-9)
    assert np.allclose(one @ two, three, atol=1e-14) and np.allclose(one.sum(1), 1)


def test_simulated_sequences_follow_the_model(spark):
    tree = materialize(parse_newick(spark.createDataFrame(
        [(0, "(A:0.3,B:0.2);")], "tree_id bigint, newick string")))
    sites = spark.range(40_000).select(F.lit(0).cast("bigint").alias("tree_id"), F.col("id").alias("site"))
    states = simulate_sequences(tree, sites, seed=3)
    wide = states.groupBy("site").pivot("label", ["A", "B"]).agg(F.first("state"))
    same = wide.agg(F.avg((F.col("A") == F.col("B")).cast("double"))).first()[0]
    assert same == pytest.approx(0.25 + 0.75 * math.exp(-4 / 3 * 0.5), abs=0.01)


@pytest.mark.parametrize("layout", ["balanced", "pruning"])
def test_consed_sub_patterns(spark, layout):
    """Values as by blocks; each sub-pattern once in the whole job, whatever the partitions; long keys are digests."""
    rng = np.random.default_rng(2)
    names = [f"t{k}" for k in range(30 if layout == "balanced" else 9)]
    newick = "".join(f"({a}:0.{k % 9 + 1}," for k, a in enumerate(names[:-1])) + f"{names[-1]}:0.2" + "):0.1" * (len(names) - 2) + ");"
    trees = spark.createDataFrame([(4, newick)], "tree_id bigint, newick string")
    plan = materialize(decompose(resolve(parse_newick(trees)), layout), "plan")
    base = ["".join(rng.choice(list("0123e"), len(names))) for _ in range(12)]
    rows = sorted({b[:k] + c[k:] for b in base for c in base for k in (0, 4, 20)})
    patterns = spark.createDataFrame([(k, p, k % 3 + 1) for k, p in enumerate(rows)], "pattern_id bigint, pattern string, freq bigint").repartition(7)
    taxa = spark.createDataFrame(list(enumerate(names)), "taxon_id bigint, taxon string")
    model = HKY85(2.0, [0.1, 0.2, 0.3, 0.4])
    scored, entries = consed_loglik(patterns, plan, taxa, model)
    got = {r.pattern_id: r.loglik for r in scored.collect()}
    want = {r.pattern_id: r.loglik for r in pattern_loglik(patterns, plan, taxa, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    placed = materialize(plan_with_taxa(plan, taxa), "plan")
    of_taxa = {r.comp_id: r.taxa for r in component_taxa(placed).collect()} if layout == "balanced" else {}
    counts = {r.comp_id: r["count"] for r in entries.groupBy("comp_id").count().collect()}
    for comp, members in of_taxa.items():
        if comp in counts:
            assert counts[comp] == len({tuple(p[t] for t in members) for p in rows})
    assert consed_loglik(patterns.limit(0), plan, taxa, model)[0].count() == 0
