"""Patterns, trees, files and names on small fixtures with known results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.functions import codes
from cladeloom.functions.models import HKY85, GeneralReversible, JukesCantor
from cladeloom.operators import patterns as P
from cladeloom.operators import trees as O
from cladeloom.operators.names import closest_by_pieces, match_names
from cladeloom.operators.ranking import global_rank, rank_in_group, with_previous
from cladeloom.operators.simulate import DISTRIBUTIONS, scale_to_height, simulate_trees
from cladeloom.operators import tour
from cladeloom.operators.linked import list_ranks, preorder
from cladeloom.operators.tour import spanning_tree, tour_order
from cladeloom.plans.decomposition import decompose
from cladeloom.session import materialize
from cladeloom.sources import newick as X
from cladeloom.sources.phylip import read_phylip, write_phylip


def parse(spark, *texts):
    return materialize(X.parse_newick(
        spark.createDataFrame(list(enumerate(texts)), "tree_id bigint, newick string")))


def test_codes(spark):
    df = spark.createDataFrame([("ACGTURYSWKMDVHB?NX-acgtn",)], "s string")
    s = df.select(codes.symbols_from_letters(F.col("s")).alias("x"))
    assert s.first().x == "0123345678" + "9abcdeeee" + "0123e"
    assert s.select(codes.letters_from_symbols(F.col("x"))).first()[0] == "ACGTTRYSWKMDVHB????ACGT?"
    with pytest.raises(Exception, match="not a nucleotide"):
        spark.createDataFrame([("ACZ",)], "s string").select(
            codes.symbols_from_letters(F.col("s"))).collect()


def test_ranks_small_and_large_agree(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    small = {r.k: r.n for r in global_rank(df, [F.col("k")], "n").collect()}
    large = {r.k: r.n for r in global_rank(df, [F.col("k")], "n", max_window=10).collect()}
    assert small == large == {k: k for k in range(5000)}
    window = rank_in_group(df, "g", [F.col("k")], "n", small=True)
    spread = rank_in_group(df, "g", [F.col("k")], "n")
    assert sorted(window.select("g", "k", "n").collect()) == sorted(spread.select("g", "k", "n").collect())
    lagged = with_previous(global_rank(df, [F.col("k")], "n"), "n", ["k"], block=64)
    assert all(r.prev_k == (r.k - 1 if r.k else None) for r in lagged.collect())


def test_patterns(spark):
    rows = [(0, "00e3"), (1, "0123"), (2, "0123")]
    sites = P.transpose(spark.createDataFrame(rows, "taxon_id bigint, symbols string"), 3, 4)
    assert [r.pattern for r in sites.orderBy("site").collect()] == ["000", "011", "e22", "333"]
    counted = P.transpose(spark.createDataFrame(rows, "taxon_id bigint, symbols string"))
    assert counted.exceptAll(sites).isEmpty() and counted.count() == 4
    with pytest.raises(Exception, match="does not have"):
        P.transpose(spark.createDataFrame(rows, "taxon_id bigint, symbols string"), 3, 2).collect()
    many = spark.createDataFrame([(k, p) for k, p in enumerate(["10", "01", "00", "01", "11"])],
                                 "site bigint, pattern string")
    lex = P.compress_patterns(many).orderBy("pattern_id").collect()
    assert [(r.pattern, r.freq) for r in lex] == [("00", 1), ("01", 2), ("10", 1), ("11", 1)]
    zig = P.compress_patterns(many, "zigzag").orderBy("pattern_id").collect()
    assert [r.pattern for r in zig] == ["01", "00", "11", "10"]
    assert P.compress_patterns(many, "uncompressed").count() == 5
    diffs = P.pattern_diffs(P.compress_patterns(many)).orderBy("pattern_id", "taxon_id").collect()
    assert [(r.pattern_id, r.taxon_id, r.symbol) for r in diffs] == [
        (0, 0, "0"), (0, 1, "0"), (1, 1, "1"), (2, 0, "1"), (2, 1, "0"), (3, 1, "1")]


def test_transpose_in_narrow_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_CELLS", 8)
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 4, (4, 23))
    rows = [(k, "".join(map(str, r))) for k, r in enumerate(grid)]
    sites = P.transpose(spark.createDataFrame(rows, "taxon_id bigint, symbols string"), 4, 23)
    got = {r.site: r.pattern for r in sites.collect()}
    assert got == {s: "".join(map(str, grid[:, s])) for s in range(23)}


def _mst_weight(items):
    d = lambda a, b: sum(x != y for x, y in zip(a, b))
    inside, total = {0}, 0
    while len(inside) < len(items):
        w, v = min((d(items[u], items[v]), v) for u in inside for v in range(len(items)) if v not in inside)
        inside.add(v)
        total += w
    return total


def test_tour(spark):
    rng = np.random.default_rng(4)
    items = sorted({"".join(map(str, r)) for r in rng.integers(0, 3, (60, 6))})
    df = spark.createDataFrame([(p, 1) for p in items], "pattern string, freq bigint")
    rows = tour_order(df).orderBy("pattern_id").collect()
    assert sorted(r.pattern for r in rows) == items and rows[0].pattern == items[0]
    length = P.path_length(tour_order(df)).first().path_length
    assert length <= 2 * _mst_weight(items)
    assert [r.pattern_id for r in rows] == list(range(len(items)))
    assert [tuple(r) for r in tour_order(df.repartition(7)).orderBy("pattern_id").collect()] == [tuple(r) for r in rows]
    for limit in (0, 1_000_000):  # rounds of joins, and one task
        edges = spanning_tree(df, limit)[1].collect()
        assert sum(e.w for e in edges) == _mst_weight(items)
    assert sorted(map(tuple, edges)) == sorted(map(tuple, spanning_tree(df, 0)[1].collect()))


def test_tour_of_many_taxa(spark, monkeypatch):
    """Beyond the masks, rotated orders join what is left; the walk still visits every pattern once."""
    monkeypatch.setattr(tour, "MASKS", 30)
    rng = np.random.default_rng(9)
    items = sorted({"".join(map(str, r)) for r in rng.integers(0, 2, (40, 30))})
    df = spark.createDataFrame([(p, 2) for p in items], "pattern string, freq bigint")
    rows = tour_order(df).orderBy("pattern_id").collect()
    assert sorted(r.pattern for r in rows) == items and [r.pattern_id for r in rows] == list(range(len(items)))
    assert spanning_tree(df)[1].agg(F.sum("w")).first()[0] < 1.5 * _mst_weight(items)


def test_tour_of_few_patterns(spark):
    one = spark.createDataFrame([("01", 3)], "pattern string, freq bigint")
    assert [tuple(r) for r in tour_order(one).collect()] == [(0, "01", 3)]
    assert tour_order(one.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_preorder_of_odd_trees(spark, limit):
    """A long chain, a star and two small trees, ranked by joins and in one task."""
    n = 500
    chain = [(k, k + 1) for k in range(n)]
    star = [(2000, 2001 + k) for k in range(n)]
    small = [(5000, 5003), (5003, 5001), (5003, 5002), (6001, 6000)]
    edges = spark.createDataFrame(chain + star + small, "a bigint, b bigint")
    roots = spark.createDataFrame([(0,), (2000,), (5000,), (6000,), (9000,)], "node bigint")
    got = {r.node: (r.root, r.parent, r.place) for r in preorder(edges, roots, limit).collect()}
    want = {}
    for root, order in ((0, range(n + 1)), (2000, range(2000, 2001 + n)), (5000, [5000, 5003, 5001, 5002]), (6000, [6000, 6001]), (9000, [9000])):
        up = {b: a for a, b in chain + star + small[:3]} | {6001: 6000}
        for node in order:
            want[node] = (root, up.get(node) if node != root else None, len(want))
    assert got == want


def test_circles_are_left_out(spark):
    links = spark.createDataFrame([(1, 2), (2, None), (5, 6), (6, 5)], "id bigint, next bigint")
    for limit in (0, 10):
        assert sorted(map(tuple, list_ranks(links, limit).collect())) == [(1, 1), (2, 0)]


def test_newick_round_trip(spark):
    texts = ["((A:0.1,B:0.2):0.05,(C:0.3,D:0.15):0.25)r:0.0", "(A:1.0,B[x y]:2.0,(C:0.5):3.0)q:0.5"]
    nodes = parse(spark, *texts)
    out = {r.tree_id: r.newick for r in X.to_newick(nodes, meta=True).collect()}
    assert out == {0: texts[0], 1: texts[1].replace("x y", "xy")}
    assert {r.tree_id: r.newick for r in X.to_newick(nodes, lengths=False).collect()}[1] == "(A,B,(C))q"


@pytest.mark.parametrize("bad", ["((A,B);", "(A,B));", "(,A);", "(A,);", "(A B[x]C);", "(A:x,B);"])
def test_newick_errors(spark, bad):
    with pytest.raises(Exception, match="malformed|cast|CAST"):
        X.parse_newick(
            spark.createDataFrame([(0, bad)], "tree_id bigint, newick string")).collect()


def test_newick_files(spark, tmp_path):
    (tmp_path / "a.nwk").write_text("(A:1,B:2);\n(C,\n D)x:3;(E,F)\n(G,H)")
    (tmp_path / "b.nwk").write_text("(Z:1,Y:2);")
    (tmp_path / "c.nwk").write_text("")
    rows = X.read_newick_text(spark, str(tmp_path)).orderBy("file", "tree_number").collect()
    assert [(r.file[-5:], r.tree_number, r.newick) for r in rows] == [
        ("a.nwk", 1, "(A:1,B:2)"), ("a.nwk", 2, "(C,D)x:3"), ("a.nwk", 3, "(E,F)"),
        ("a.nwk", 4, "(G,H)"), ("b.nwk", 1, "(Z:1,Y:2)")]
    taxa = spark.createDataFrame([(0, "A")], "taxon_id bigint, taxon string")
    nodes = parse(spark, "(A,Q);")
    assert X.attach_taxa(nodes, taxa, check=False).filter("taxon_id is null and is_leaf").count() == 1
    with pytest.raises(Exception, match="not in the alignment"):
        X.attach_taxa(nodes, taxa).collect()


def test_newick_file_split_over_tasks(spark, tmp_path):
    text = "".join(f"(A{k}:1,B{k}:2);\n" for k in range(3000))
    (tmp_path / "many.nwk").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = X.read_newick_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.tree_number: r.newick for r in rows} == {
        k + 1: f"(A{k}:1,B{k}:2)" for k in range(3000)}


def test_phylip(spark, tmp_path):
    path = tmp_path / "x.phy"
    path.write_text("3\t4\nalpha ACGT\nbeta\n  AC-n\n\ngamma RYUU\nextra AAAA\n")
    rows = read_phylip(spark, str(path)).orderBy("taxon_id").collect()
    assert [(r.taxon_id, r.taxon, r.symbols) for r in rows] == [
        (0, "alpha", "0123"), (1, "beta", "01ee"), (2, "gamma", "4533")]
    out = str(tmp_path / "out")
    write_phylip(read_phylip(spark, str(path)), out)
    again = read_phylip(spark, out, per_file=False).orderBy("taxon_id").collect()
    assert [(r.taxon, r.symbols) for r in again] == [(r.taxon, r.symbols) for r in rows]
    for bad, message in (("3 4\na ACGT\nb ACGT\n", "fewer"), ("2 4\na ACGT\na ACGT\n", "repeated"),
                         ("1 4\na ACG\n", "wrong length"), ("1 3\na AZG\n", "not a nucleotide")):
        p = tmp_path / "bad.phy"
        p.write_text(bad)
        with pytest.raises(Exception, match=message):
            read_phylip(spark, str(p)).collect()


def test_checks_survive_pruned_columns(spark, tmp_path):
    bad = spark.createDataFrame([(0, "((A,B);")], "tree_id bigint, newick string")
    with pytest.raises(Exception, match="malformed"):
        X.parse_newick(bad).groupBy("tree_id").count().collect()
    with pytest.raises(Exception, match="not in the alignment"):
        taxa = spark.createDataFrame([(0, "A")], "taxon_id bigint, taxon string")
        X.attach_taxa(parse(spark, "(A,Q);"), taxa).count()
    (tmp_path / "short.phy").write_text("3 4\na ACGT\nb ACGT\n")
    with pytest.raises(Exception, match="fewer"):
        read_phylip(spark, str(tmp_path / "short.phy")).select("taxon_id").count()
    (tmp_path / "long.phy").write_text("1 4\na ACGTA\n")
    with pytest.raises(Exception, match="wrong length"):
        read_phylip(spark, str(tmp_path / "long.phy")).count()


def test_phylip_keeps_rows_when_the_split_size_changes(spark, tmp_path):
    lines = "".join(f"taxon{k}\n{'ACGT' * 5}\n" for k in range(400))
    (tmp_path / "many.phy").write_text("400 20\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = read_phylip(spark, str(tmp_path / "many.phy"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.taxon_id, r.taxon) for r in rows.orderBy("taxon_id").collect()] == [
        (k, f"taxon{k}") for k in range(400)]


def test_siblings_and_heights(spark):
    nodes = parse(spark, "(A:1,(B:1,C:1):1,D:1);")
    at = nodes.filter("label = 'A'").select("tree_id", "node_id")
    new = at.select("tree_id", F.col("node_id").alias("after"), F.lit(90).cast("bigint").alias("node_id"),
                    F.lit("N").alias("label"), F.lit("").alias("meta"), F.lit(2.0).alias("length"),
                    F.lit(True).alias("is_leaf"))
    plain = nodes.drop("depth", "pre", "post")
    grown = X.to_newick(O.number_nodes(O.insert_siblings(plain, new))).first().newick
    assert grown == "(A:1.0,N:2.0,(B:1.0,C:1.0):1.0,D:1.0):0.0"
    hung = X.to_newick(O.number_nodes(O.graft_siblings(plain, parse(spark, "(X:1,Y:1);").drop("depth", "pre", "post"), at)))
    assert hung.first().newick == "(A:1.0,(X:1.0,Y:1.0):0.0,(B:1.0,C:1.0):1.0,D:1.0):0.0"
    with pytest.raises(Exception, match="root"):
        O.graft_siblings(plain, plain, nodes.filter("parent_id is null"))
    deep = parse(spark, "((((A:1,B:1):1,C:1):1,D:1):1,E:1);")
    heights = {r.node_id: r.edge_height for r in O.node_heights(O.root_distances(deep)).collect()}
    assert sorted(heights.values()) == [0, 0, 0, 0, 0, 1, 2, 3, 4]


def test_resolve_shapes(spark):
    nodes = parse(spark, "(A:1,B:2,C:3,D:4,E:5);", "(((A:1):2):3,(B:1,C:1,D:1):1);", "((((A:1,B:1):1):1):1);")
    out = {r.tree_id: r.newick for r in X.to_newick(O.resolve(nodes)).collect()}
    assert out == {
        0: "((((A:1.0,B:2.0):0.0,C:3.0):0.0,D:4.0):0.0,E:5.0):0.0",
        1: "(A:1.0,((B:1.0,C:1.0):0.0,D:1.0):1.0):0.0",
        2: "(A:1.0,B:1.0):1.0",
    }


def test_resolve_large_path_agrees(spark, monkeypatch):
    nodes = parse(spark, "(A:1,(B:1,C:1,(D:2):4,E:1,F:1):1,(G:3,H:1):1);", "((A:1,B:1,C:1,D:2):1,E:1);")
    small = sorted(map(tuple, O.resolve(nodes).collect()), key=str)
    monkeypatch.setattr(O, "groups_are_small", lambda *a, **k: False)
    assert sorted(map(tuple, O.resolve(nodes).collect()), key=str) == small


def test_random_trees(spark):
    reps = spark.createDataFrame([(k, n) for k, n in enumerate([2, 3, 10, 57])], "tree_id bigint, n_taxa int")
    for d in DISTRIBUTIONS:
        nodes = materialize(scale_to_height(simulate_trees(reps, d), 0.5))
        again = scale_to_height(simulate_trees(reps, d), 0.5)
        assert nodes.exceptAll(again).isEmpty()
        walked = O.root_distances(nodes.drop("depth", "dist"))
        assert walked.select("tree_id", "node_id", "depth").exceptAll(
            nodes.select("tree_id", "node_id", "depth")).isEmpty()
        for r in O.tree_metrics(nodes).collect():
            n = [2, 3, 10, 57][r.tree_id]
            assert (r.n_leaves, r.n_nodes, r.is_binary) == (n, 2 * n - 1, True)
            assert r.root_to_tip == pytest.approx(0.5)
            if d == "caterpillar":
                assert r.height == n - 1
        if d in ("yule", "beta_critical"):
            spread = nodes.filter("is_leaf").groupBy("tree_id").agg(
                (F.max("dist") - F.min("dist")).alias("s")).collect()
            assert all(r.s < 1e-9 for r in spread)
        sizes = decompose(nodes).groupBy("tree_id").count().collect()
        assert {r.tree_id: r["count"] for r in sizes} == {
            k: 4 * n - 5 for k, n in enumerate([2, 3, 10, 57])}


def test_planner_by_joins_equals_planner_in_tasks(spark):
    reps = spark.createDataFrame([(k, n) for k, n in enumerate([2, 9, 24])], "tree_id bigint, n_taxa int")
    nodes = None
    for k, d in enumerate(DISTRIBUTIONS):
        part = simulate_trees(reps, d).withColumn("tree_id", F.col("tree_id") + 10 * k)
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = materialize(nodes)
    tasks, joins = materialize(decompose(nodes)), materialize(decompose(nodes, max_grouped_nodes=0))
    assert tasks.exceptAll(joins).isEmpty() and joins.exceptAll(tasks).isEmpty()


def test_tree_edits(spark):
    nodes = parse(spark, "((A:1,B:2)u:3,(C:4,D:5)v:6)r:0;")
    ids = {r.label: r.node_id for r in nodes.collect()}
    pick = lambda name: nodes.filter(F.col("label") == name)

    def text(df):
        fresh = O.number_nodes(df.select("tree_id", "node_id", "parent_id", "child_ord", "label", "length", "is_leaf"))
        return X.to_newick(fresh).first().newick

    assert text(O.contract(nodes, pick("u"))) == "(B:2.0,A:1.0,(C:4.0,D:5.0)v:6.0)r:0.0"
    assert text(O.erase_subtree(nodes, pick("u"))) == "((C:4.0,D:5.0)v:6.0)r:0.0"
    assert text(O.reverse_children(nodes)) == "((D:5.0,C:4.0)v:6.0,(B:2.0,A:1.0)u:3.0)r:0.0"
    assert text(O.reverse_children(nodes, pick("r"))) == "((C:4.0,D:5.0)v:6.0,(A:1.0,B:2.0)u:3.0)r:0.0"
    assert text(O.reroot(nodes, pick("u"))) == "(((C:4.0,D:5.0)v:6.0)r:3.0,A:1.0,B:2.0)u:0.0"
    grafted = O.graft(nodes, parse(spark, "(X:1,Y:1)w:7;"), pick("A"))
    assert text(grafted) == "((((X:1.0,Y:1.0)w:7.0)A:1.0,B:2.0)u:3.0,(C:4.0,D:5.0)v:6.0)r:0.0"
    assert O.same_trees(nodes, nodes, ["label", "length"])
    assert not O.same_trees(nodes, nodes.withColumn("length", F.col("length") * 2), ["length"])
    assert O.check_topology(nodes).isEmpty()
    assert O.check_topology(nodes.filter("label <> 'v'")).count() == 2
    assert {r.node_id for r in O.in_subtree(nodes, pick("v")).collect()} == {
        ids["v"], ids["C"], ids["D"]}


NAME_CASES = [
    ("abc", ["abd", "abc"], 1, "exact"),
    ("a_bc", ["ABC", "abc", "abx"], 1, "punctuation"),
    ("ABC", ["abd", "abc"], 1, "case"),
    ("a_bc", ["A_BC", "a-bc"], 1, "punctuation"),
    ("abcd", ["abxx", "abc", "abcx"], 1, "distance"),
    ("anything", [], -1, "distance"),
]


@pytest.mark.parametrize("query, names, idx, kind", NAME_CASES)
def test_name_match(spark, query, names, idx, kind):
    candidates = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    got = match_names(spark.createDataFrame([(query,)], "query string"), candidates).first()
    assert (got.idx, got.kind) == (idx, kind)


def test_name_match_in_blocks(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 6)))
    names, queries = [word() for _ in range(40)], sorted({word() + "z" for _ in range(30)})

    def gap(a, b):
        return sum(x != y for x, y in itertools.zip_longest(a, b))

    candidates = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got = {r.query: (r.distance, r.idx) for r in match_names(asked, candidates, block_rows=7).collect()}
    assert got == {q: min((gap(q, n), k) for k, n in enumerate(names)) for q in queries}


def test_names_by_pieces(spark):
    """Nearest names within the reach, lowest index among ties, with far fewer comparisons than pairs."""
    rng = np.random.default_rng(6)
    names = [f"Species#{k:06d} of é" for k in range(1500)] + ["Sp", "", "Species#000001 of é and more"]
    asked = set()
    for k in range(120):
        name = list(names[rng.integers(1500)])
        for at in rng.integers(0, len(name), rng.integers(1, 6)):
            name[at] = str(rng.choice(list("0123456789xé")))
        asked.add("".join(name) + "!" * int(rng.integers(0, 3)))
    asked |= {"", "S", "zzzz", "Species#000001 of é and mor"}

    def gap(a, b):
        a, b = a.encode(), b.encode()
        return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))

    want = {q: min((gap(q, n), k) for k, n in enumerate(names)) for q in asked}
    candidates = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    near, far = closest_by_pieces(queries, candidates)
    rows = near.collect()
    assert {r.query: (r.distance, r.idx) for r in rows} == {q: w for q, w in want.items() if w[0] <= 3}
    assert {r.query for r in far.collect()} == {q for q, w in want.items() if w[0] > 3}
    near = [r for r in rows if r.distance <= 1]
    assert len(near) > 20 and sum(r.pairs for r in near) < 0.02 * len(near) * len(names)
    assert len(rows) > 50 and sum(r.pairs for r in rows) < 0.25 * len(rows) * len(names)
    assert closest_by_pieces(queries, candidates.limit(0))[0].count() == 0


def test_files_with_trees_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.nwk").write_text("(A:1,B:2);\n(C,(D,E)x);")
    (tmp_path / "cut.nwk").write_text("(A:1,(B:2,C;(G,H:3);((;")
    (tmp_path / "comment.nwk").write_text("(A,B[no end);")
    (tmp_path / "empty.nwk").write_text("")
    names = ["good", "cut", "comment", "empty", "absent"]
    nodes, rejects = X.read_trees(spark, [f"{tmp_path}/{n}.nwk" for n in names])
    got = {(r.file.split("/")[-1], r.tree_number): r.n for r in
           nodes.groupBy("tree_id.file", "tree_id.tree_number").agg(F.count("*").alias("n")).collect()}
    assert got == {("good.nwk", 1): 3, ("good.nwk", 2): 5, ("cut.nwk", 2): 3}
    bad = {(r.file.split("/")[-1], r.tree_number, r.reason) for r in rejects.collect()}
    assert bad == {("cut.nwk", 1, "malformed"), ("cut.nwk", 3, "malformed"), ("comment.nwk", 1, "malformed"),
                   ("absent.nwk", None, "cannot be read")}
    assert X.read_trees(spark, [f"{tmp_path}/none.nwk"])[0].count() == 0


def test_new_taxa_follow_the_known_ones(spark):
    trees = spark.createDataFrame([(2, "(C,(zed,A));"), (1, "((B,new),A);")], "tree_id bigint, newick string")
    taxa = spark.createDataFrame([("A", 0), ("B", 4)], "taxon string, taxon_id bigint")
    named, every = X.attach_new_taxa(X.parse_newick(trees), taxa)
    want = {"A": 0, "B": 4, "new": 5, "C": 6, "zed": 7}
    assert {r.taxon: r.taxon_id for r in every.collect()} == want
    assert all(r.taxon_id == want[r.label] for r in named.filter("is_leaf").collect())
    none = X.attach_new_taxa(X.parse_newick(trees), taxa.limit(0))[1]
    assert {r.taxon: r.taxon_id for r in none.collect()} == {"B": 0, "new": 1, "A": 2, "C": 3, "zed": 4}


def test_compare_trees(spark):
    texts = ["((A:1,B:2)x:1,C:3);", "((A:1,B:2)x:1,C:3);", "((A:1,B:2)x:1,C:4);", "(C:3,(A:1,B:2)x:1);", "((A:1,B:2):1,C:3);", "(A,B);"]
    nodes = parse(spark, *texts)
    pairs = spark.createDataFrame([(0, k) for k in range(6)] + [(0, 99), (98, 99), (0, 1)], "left_id bigint, right_id bigint")
    got = {(r.left_id, r.right_id): (r.equal, r.first_difference) for r in
           O.compare_trees(nodes, nodes, pairs, ["label", "length"]).collect()}
    assert got == {(0, 0): (True, None), (0, 1): (True, None), (0, 2): (False, 4), (0, 3): (False, 1), (0, 4): (False, 1),
                   (0, 5): (False, 0), (0, 99): (False, 0), (98, 99): (True, None)}
    shapes = O.compare_trees(nodes, nodes, pairs.filter("right_id IN (2, 4)"), [])
    assert all(r.equal for r in shapes.collect())


def test_general_reversible_model():
    pi, kappa = (0.3, 0.2, 0.2, 0.3), 2.5
    t = np.array([0.0, 0.01, 0.3, 5.0])
    gtr = GeneralReversible((1, kappa, 1, 1, kappa, 1), pi)
    assert np.allclose(gtr.matrices(t), HKY85(kappa, pi).matrices(t), atol=1e-12)
    assert np.allclose(GeneralReversible((2,) * 6).matrices(t), JukesCantor().matrices(t), atol=1e-12)
    odd = GeneralReversible((1.0, 3.5, 0.7, 0.9, 4.0, 0.0), (3, 2.5, 1.5, 3))
    p = odd.matrices(t)
    assert np.allclose(p.sum(2), 1) and np.allclose(p[0], np.eye(4))
    assert np.allclose(np.array(odd.pi)[:, None] * p[2], (np.array(odd.pi)[:, None] * p[2]).T)
    assert np.allclose(p[1] @ p[1], odd.matrices([0.02])[0])
    for bad in (((1,) * 5,), ((1,) * 5 + (-1,),), ((0,) * 6,), ((1,) * 6, (1, 1, 1, 0))):
        with pytest.raises(ValueError):
            GeneralReversible(*bad)


def test_names_with_foreign_bytes(spark, monkeypatch):
    """Bytes that no candidate has at their place are far from all: no pairs of names and candidates are compared."""
    from cladeloom.operators import names as N

    names = [f"Species#{k:06d}" for k in range(300)] * 3 + ["é", None]  # equal names count as one, the lowest index wins
    asked = [n.replace("00", "0x") + "y" for n in names[:300]] + ["Species#xx0123", "yy", None]

    def gap(a, b):
        a, b = a.encode(), b.encode()
        return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))

    want = {q: min((gap(q, n), k) for k, n in enumerate(names[:-1])) for q in asked[:-1]}
    candidates = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    near, far = N.closest_by_masks(queries, candidates)
    assert {r.query: (r.distance, r.idx) for r in near.collect()} == want
    assert {r.query for r in far.collect()} == {None}
    few, rest = N.closest_by_masks(queries, candidates, max_masks=1)
    assert 0 < few.count() < near.count() and few.count() + rest.count() == len(asked)

    def refuse(*args):
        raise AssertionError("all pairs")

    monkeypatch.setattr(N, "closest_by_distance", refuse)
    got = match_names(queries.filter("endswith(query, 'y') AND query != 'yy'"), candidates.filter("name IS NOT NULL"))
    assert {r.query: (r.distance, r.idx) for r in got.collect()} == {q: w for q, w in want.items() if q.endswith("y") and q != "yy"}


def test_trees_in_tasks_agree_with_joins(spark, monkeypatch):
    """Numbers, heights and resolution of odd trees: in tasks, by joins, and with some trees too large for a task."""
    from cladeloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = []
    for t in range(40):
        n = int(rng.integers(1, 30))
        ids = rng.permutation(n * 3)[:n].tolist()
        for k, node in enumerate(ids):
            up = None if k == 0 else ids[int(rng.integers(k)) if t % 2 else max(0, k - int(rng.integers(1, 3)))]
            length = None if rng.random() < 0.05 else float(rng.integers(1, 9))
            rows.append((t - 5, node, up, -k if t % 3 else k, f"n{k}", length))
    rows += [(99, 1, 7, 0, "lost", 1.0)]  # a parent that is not there
    plain = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, child_ord bigint, label string, length double")
    inner = plain.select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    plain = materialize(plain.join(inner, ["tree_id", "node_id"], "left").withColumn("is_leaf", F.col("_in").isNull()).drop("_in"))

    def same(name, by_joins, nodes):
        whole = getattr(O, name)(nodes)
        want = sorted(map(str, by_joins(nodes).select(*whole.columns).collect()))
        for got in (whole, getattr(O, name)(nodes, max_rows=12).select(*whole.columns)):
            assert sorted(map(str, got.collect())) == want, name

    same("root_distances", O._root_distances_by_joins, plain)
    same("number_nodes", O._number_by_joins, plain)
    numbered = O.number_nodes(plain)
    assert numbered.filter("tree_id = 99").isEmpty()
    same("node_heights", O._node_heights_by_joins, plain)
    same("resolve", O._resolve_by_joins, numbered)


def test_inserted_children_in_tasks(spark, monkeypatch):
    nodes = parse(spark, "(A:1,(B:1,C:1):1,D:1);").drop("meta")
    new = nodes.filter("label IN ('A', 'C')").withColumn("parent_id", F.col("node_id")).withColumn("node_id", F.col("node_id") + 100)
    by_joins = sorted(map(str, O.insert_children(nodes, new, max_rows=2).collect()))
    monkeypatch.setattr(O, "_insert_children_by_joins", None)  # trees that fit a task join nothing
    got = O.insert_children(nodes, new).collect()
    assert sorted(map(str, got)) == by_joins
    assert sorted((r.node_id, r.is_leaf) for r in got if r.label in ("A", "B", "C")) == [
        (0, False), (1, True), (2, False), (100, True), (102, True)]


def test_trees_are_shuffled_once(spark, monkeypatch):
    """Walks and resolution of trees that fit a task join nothing."""
    def refuse(*args, **kwargs):
        raise AssertionError("joins")

    for name in ("_root_distances_by_joins", "_number_by_joins", "_node_heights_by_joins", "_resolve_by_joins"):
        monkeypatch.setattr(O, name, refuse)
    nodes = parse(spark, "(A:1,(B:1,C:1):1,D:1);").drop("depth", "pre", "post")
    numbered = O.number_nodes(nodes)
    assert O.node_heights(nodes).count() == O.root_distances(nodes).count() == 6
    assert O.tree_metrics(O.resolve(numbered)).first().is_binary


def test_newick_in_batches_agrees_with_windows(spark, monkeypatch):
    """Well-formed and broken texts, comments, odd numbers; whole texts meet no shuffle of their tokens."""
    texts = ["(A:1,(B:2.5,C)x[n]:1e-3,D[m]:.5)r;", "A;", "(A,B);", "((((A:1):2):3):4):5;", "(A,B", "A,B)", "(A,,B);", "()", "", "(((",
             "(A:1:2,B);", "(A:x,B);", "(A:NaN,B:1d);", "(A:,B);", "(A[a:b,(c],B[]:2)[z]:3;", "(A B:1,C)(D);", "(A,B)C D;", "(A:1,B:2):",
             "[c](A,B);", "(A:+1.,B:-2)'q' ;x", "((A,B),(C,D));(E,F);", "(A)B)C(", "x]y;", "(é:1,ü:2)ß;"]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("((()),,:1A[]"), int(rng.integers(2, 14)))) for _ in range(300)]
    trees = materialize(spark.createDataFrame(list(enumerate(texts)), "tree_id bigint, newick string"))
    text = F.split(F.regexp_replace("newick", r"\s+", ""), ";" + X.OUTSIDE_COMMENT)[0]
    want = X._parsed_by_windows(trees.select("tree_id", text.alias("newick")), 7.0).collect()
    got = X._parsed(trees, 7.0).collect()
    assert sorted(map(str, (r for r in got if not r.broken))) == sorted(map(str, (r for r in want if not r.broken)))
    assert {r.tree_id for r in got if r.broken} == {r.tree_id for r in want if r.broken}
    assert len({r.tree_id for r in got if not r.broken}) > 12
    plain = trees.filter("newick LIKE '((A,B),%'")
    plan = X._parsed(plain, 7.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "MapInPandas" in plan


def _odd_trees(spark):
    rng = np.random.default_rng(8)
    rows = []
    for t in range(60):
        n = int(rng.integers(1, 60))
        ids = rng.permutation(n * 3)[:n].tolist()
        for k, node in enumerate(ids):
            up = None if k == 0 else ids[int(rng.integers(k)) if t % 2 else max(0, k - int(rng.integers(1, 3)))]
            rows.append((t, node, up, k % 7, f"n{k}", None if rng.random() < 0.03 else float(rng.integers(1, 9))))
    plain = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, child_ord bigint, label string, length double")
    inner = plain.select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    return materialize(plain.join(inner, ["tree_id", "node_id"], "left").withColumn("is_leaf", F.col("_in").isNull()).drop("_in"))


def test_plans_in_one_pass(spark, monkeypatch):
    """Resolved and planned in one pass: the rows of the planners that take one tree or one layer at a time."""
    from cladeloom.operators import blocks
    from cladeloom.plans import decomposition as D

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 200)
    plain = _odd_trees(spark)
    resolved = materialize(O.resolve(O.number_nodes(plain)))
    frame = resolved.toPandas().sort_values(["tree_id", "post"]).reset_index(drop=True)
    one_by_one = spark.createDataFrame(next(D._plan_frame(frame, False)), D.PLAN_SCHEMA)
    numbers = F.transform(F.array("span", "length"), lambda x: F.when(F.isnan(x), None).otherwise(x))

    def rows(df):  # NaN of pandas is NULL in Spark
        return sorted(map(str, df.withColumn("span", numbers[0]).withColumn("length", numbers[1]).select(*D._PLAN_COLUMNS).collect()))

    want = rows(one_by_one)
    for got in (D.resolve_and_plan(plain), decompose(resolved)):
        assert rows(got) == want
    assert rows(D.resolve_and_plan(plain, "pruning")) == rows(decompose(resolved, "pruning"))
    both = D.layout_heights(D.resolve_and_plan(plain, columns=["tree_id", "merge_type", "is_clade", "depth", "node_depth"]))
    alone = D.plan_heights(decompose(resolved)).join(D.pruning_heights(resolved), "tree_id")
    assert sorted(map(str, both.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))


def test_long_chains_of_pairs_are_planned_at_once(spark):
    """A caterpillar, whose pairs all wait for each other."""
    from cladeloom.plans import decomposition as D

    n = 400
    rows = [(0, 2 * k, None if k == 0 else 2 * k - 2, 0, False) for k in range(n)]
    rows += [(0, 2 * k + 1, 2 * k, 1, True) for k in range(n)] + [(0, 2 * n, 2 * n - 2, 0, True)]
    plain = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, child_ord bigint, is_leaf boolean")
    plain = plain.withColumns({"label": F.lit("x"), "length": F.lit(1.0)})
    plan = D.resolve_and_plan(plain)
    assert plan.count() == 4 * (n + 1) - 5
    frame = O.resolve(plain).toPandas().sort_values("post")
    want = next(D._plan_frame(frame, False))
    got = plan.select("comp_id", "merge_type", "depth").toPandas().sort_values("comp_id")
    for c in ("merge_type", "depth"):
        assert got[c].tolist() == want[c].tolist()


def test_forest_and_plans_write_only_what_is_asked(spark, monkeypatch, tmp_path):
    """One pass by tree from the lines of orders to heights: no table between, only asked columns written."""
    from cladeloom import session
    from cladeloom.queries import trees as T
    from cladeloom.plans import decomposition as D

    written = []
    write = session.materialize

    def noted(df, *args, **kwargs):
        if getattr(df, "_cladeloom_metrics", None) is None:
            written.append(df.columns)
        return write(df, *args, **kwargs)

    for place in (O, D, T):
        monkeypatch.setattr(place, "materialize", noted)
    for name, columns in (("pruning_heights_forest", {"tree_id", "parent_id", "is_leaf", "depth"}),
                          ("pruning_table_forest", {"tree_id", "merge_type", "depth"}),
                          ("decomp_sizes_forest", {"tree_id", "merge_type", "length", "depth"}),
                          ("decomp_heights_forest", {"tree_id", "merge_type", "is_clade", "depth", "node_depth"})):
        written.clear()
        found = T.QUERIES[name].run(spark, "/root/testdata/sf0.001")
        assert found.count() > 0
        assert [set(w) for w in written] == [columns], name
    written.clear()
    T.QUERIES["decomp_table_forest"].run(spark, "/root/testdata/sf0.001").count()
    assert len(written) == 1


def test_copies_and_new_roots_in_tasks(spark, monkeypatch):
    """Trees with copies of themselves and turned trees: in tasks without joins, and by joins where too large."""
    plain = materialize(_odd_trees(spark).filter("tree_id < 12"))
    one = plain.groupBy("tree_id").agg(F.max("node_id").alias("_new"))
    marked = materialize(plain.join(one, "tree_id").withColumn("_host", F.col("node_id") == F.col("_new")))

    def by_joins(large):
        trees = large.drop("_host", "_new")
        return O.graft(trees, trees, large.filter("_host"))

    want = sorted(map(str, O.tree_metrics(O.root_distances(by_joins(marked))).collect()))
    turned = sorted(map(str, O.reroot(
        materialize(O.number_nodes(plain)), one.withColumnRenamed("_new", "node_id")
    ).select("tree_id", "node_id", "parent_id", "length").collect()))
    at_new = F.col("node_id") == F.col("_new")
    assert sorted(map(str, O.edited_metrics(marked, O.with_copies, by_joins, max_rows=40).collect())) == want
    assert sorted(map(str, O.reroot_at(marked, at_new, max_rows=40).collect())) == turned
    assert sorted(map(str, O.edited_metrics(plain).collect())) == sorted(map(str, O.tree_metrics(O.root_distances(plain)).collect()))
    for name in ("_root_distances_by_joins", "_number_by_joins", "graft", "reroot"):
        monkeypatch.setattr(O, name, None)
    assert sorted(map(str, O.edited_metrics(marked, O.with_copies, by_joins).collect())) == want
    assert sorted(map(str, O.reroot_at(marked, at_new).collect())) == turned


def test_edited_forests_write_only_what_is_asked(spark, monkeypatch):
    """Grafted, turned and compared trees: one pass by tree, without labels."""
    from cladeloom import session
    from cladeloom.queries import trees as T

    written = []

    def noted(df, *args, **kwargs):
        if getattr(df, "_cladeloom_metrics", None) is None:
            written.append(set(df.columns))
        return session.materialize(df, *args, **kwargs)

    for place in (O, T):
        monkeypatch.setattr(place, "materialize", noted)
    for name, tables in (("graft_forest", 1), ("reroot_forest", 1), ("tree_pairs_equal", 2)):
        written.clear()
        assert T.QUERIES[name].run(spark, "/root/testdata/sf0.001").count() > 0
        assert len(written) == tables and not any({"label", "child_ord"} & w for w in written), name
