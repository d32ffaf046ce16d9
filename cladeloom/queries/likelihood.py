"""Likelihoods of data-derived alignments under fixed and data-derived trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions.models import HKY85, JukesCantor
from cladeloom.operators import patterns as P
from cladeloom.operators import trees as O
from cladeloom.operators.likelihood import joined_loglik, pattern_loglik, plan_with_taxa, tree_loglik
from cladeloom.operators.mcmc import branch_updates, prior_of_trees
from cladeloom.operators.layered import layered_loglik
from cladeloom.operators.pruning import pattern_cells, pruning_loglik
from cladeloom.operators.subpatterns import component_taxa, consed_loglik, dictionary
from cladeloom.plans.decomposition import decompose
from cladeloom.plans.merges import merge_long
from cladeloom.programs import score_trees
from cladeloom.queries.base import (
    EVENT_SITES, EVENT_TAXA, LINE_SITES, Query, rounded, sql_round,
)
from cladeloom.queries.models import GTR, KAPPA, PI, series_sql
from cladeloom.queries.trees import FOREST, SUPPLIER_TREE
from cladeloom.session import materialize
from cladeloom.sources import tables as T
from cladeloom.sources.newick import parse_newick

T5 = "((click:0.1,error:0.2):0.05,(purchase:0.3,(signup:0.15,view:0.25):0.1):0.2);"
T7 = "((1:0.1,2:0.2):0.05,((3:0.1,4:0.3):0.1,(5:0.15,(6:0.25,7:0.1):0.05):0.2):0.1);"


def one_tree(spark, newick):
    return parse_newick(spark.range(1).select(F.col("id").alias("tree_id"),
                                              F.lit(newick).alias("newick")))


def taxa_table(spark, names):
    return spark.createDataFrame(list(enumerate(map(str, names))), "taxon_id bigint, taxon string")


def event_patterns(spark, sf):
    ordered = P.compress_patterns(T.event_sites(spark, sf))
    taxa = T.taxa_of(T.read_table(spark, sf, "events"), F.col("event_type"))
    return ordered, taxa_table(spark, taxa)


def line_patterns(spark, sf):
    ordered = P.compress_patterns(T.lineitem_sites(spark, sf))
    taxa = T.taxa_of(T.read_table(spark, sf, "lineitem"), F.col("l_linenumber"))
    return ordered, taxa_table(spark, taxa)


def _site_rows(scored):
    return scored.select("pattern_id", "freq", rounded("loglik").alias("loglik"))


def site_loglik_pruning(spark, sf):
    patterns, taxa = event_patterns(spark, sf)
    return _site_rows(joined_loglik(patterns, one_tree(spark, T5), taxa))


def site_loglik_blocks(layout):
    def run(spark, sf):
        patterns, taxa = event_patterns(spark, sf)
        return _site_rows(pattern_loglik(patterns, decompose(one_tree(spark, T5), layout), taxa))

    return run


def site_loglik_lineitem(strategy):
    def run(spark, sf):
        patterns, taxa = line_patterns(spark, sf)
        plan = decompose(one_tree(spark, T7))
        return _site_rows(
            pattern_loglik(patterns, plan, taxa, HKY85(KAPPA, PI), strategy=strategy)
        )

    return run


def site_loglik_hky_joins(spark, sf):
    patterns, taxa = line_patterns(spark, sf)
    return _site_rows(joined_loglik(patterns, one_tree(spark, T7), taxa, HKY85(KAPPA, PI)))


def site_loglik_layers(spark, sf):
    patterns, taxa = line_patterns(spark, sf)
    plan = decompose(one_tree(spark, T7))
    scored = layered_loglik(pattern_cells(patterns, taxa), plan, HKY85(KAPPA, PI))
    return _site_rows(scored.join(patterns.select("pattern_id", "freq"), "pattern_id"))


def loglik_total(spark, sf):
    patterns, taxa = event_patterns(spark, sf)
    return tree_loglik(patterns, decompose(one_tree(spark, T5)), taxa).select(
        rounded("loglik").alias("loglik")
    )


def _nation_trees(spark, sf):
    """The event tree once per nation, lengths scaled by the nation key."""
    nation = T.read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("tree_id"), F.lit(T5).alias("newick")
    )
    return O.scale_lengths(parse_newick(nation), (1 + F.col("tree_id") % 7).cast("double") / 4)


def batch_scores(spark, sf):
    patterns, taxa = event_patterns(spark, sf)
    scored = score_trees(patterns, _nation_trees(spark, sf), taxa)
    return scored.select(
        "tree_id", "ntax", rounded("root_to_tip").alias("root_to_tip"),
        rounded("total_length").alias("total_length"), "n_sites", "n_patterns",
        "pruning_height", "balanced_height",
        rounded("loglik_pruning", 4).alias("loglik_pruning"),
        rounded("loglik_balanced", 4).alias("loglik_balanced"),
    )


def batch_scores_grid(spark, sf):
    """The same totals through chunks of trees against blocks of patterns."""
    patterns, taxa = event_patterns(spark, sf)
    plan = decompose(_nation_trees(spark, sf))
    return tree_loglik(
        patterns, plan, taxa, strategy="grid", chunk_components=100, block_cells=2000
    ).select("tree_id", rounded("loglik", 4).alias("loglik"))


def loglik_fk_star(spark, sf):
    """Ship months as sites, suppliers as taxa, on the region-nation-supplier tree."""
    cells = T.supplier_cells(spark, sf).withColumnRenamed("site", "pattern_id")
    nodes = O.root_distances(T.supplier_tree(spark, sf)).withColumn(
        "taxon", F.col("node_id") - 3 * T.LEVEL
    )
    scored = pruning_loglik(cells, nodes)
    return scored.select(F.col("pattern_id").alias("site"), rounded("loglik").alias("loglik"))


def branch_update(layout):
    """Every edge of the event tree lengthened by 0.1, one at a time."""

    def run(spark, sf):
        patterns, taxa = event_patterns(spark, sf)
        plan = materialize(decompose(one_tree(spark, T5), layout), "plan")
        longer = plan.filter("merge_type = 0").select(
            "comp_id", (F.col("length") + 0.1).alias("new_length")
        )
        changed = branch_updates(patterns, plan, taxa, longer, total=False)
        return changed.select("comp_id", "pattern_id", rounded("loglik").alias("loglik"))

    return run


def site_loglik_shared(spark, sf):
    """Each component computed once per distinct sub-pattern of its own taxa."""
    patterns, taxa = line_patterns(spark, sf)
    plan = decompose(one_tree(spark, T7))
    return _site_rows(pattern_loglik(patterns, plan, taxa, HKY85(KAPPA, PI), reuse=True))


def site_loglik_gtr(spark, sf):
    """A model of the user's own: six exchange rates."""
    patterns, taxa = line_patterns(spark, sf)
    return _site_rows(pattern_loglik(patterns, decompose(one_tree(spark, T7)), taxa, GTR))


def site_loglik_consed(spark, sf):
    """The same from one dictionary of sub-patterns over all partitions."""
    patterns, taxa = line_patterns(spark, sf)
    plan = decompose(one_tree(spark, T7))
    return _site_rows(consed_loglik(patterns, plan, taxa, HKY85(KAPPA, PI))[0])


def subpattern_counts(spark, sf):
    """Merged columns of each component of the whole job, named by the taxa below it."""
    patterns, taxa = line_patterns(spark, sf)
    plan = materialize(plan_with_taxa(decompose(one_tree(spark, T7)), taxa), "plan")
    entries = dictionary(patterns, plan)
    members = component_taxa(plan)
    merged = entries.groupBy("tree_id", "comp_id").agg(F.count("*").alias("n_columns"))
    named = merged.join(members, ["tree_id", "comp_id"])
    return named.groupBy(F.array_join(F.transform("taxa", lambda t: t.cast("string")), ",").alias("taxa")).agg(
        F.count("*").alias("n_components"), F.sum("n_columns").alias("n_columns"))


# The taxa of each merge of the balanced plan of T7.
_T7_PARTS = [[0, 1]] * 3 + [[2, 3]] * 2 + [[0, 1, 2, 3]] + [[4]] * 2 + [[5, 6], [4, 5, 6], [0, 1, 2, 3, 4, 5, 6]]
_SUBPATTERNS = f"""
WITH {LINE_SITES},
parts AS (SELECT unnest({_T7_PARTS}) AS taxa),
cut AS (SELECT taxa, count(DISTINCT list_transform(taxa, lambda t: substr(pattern, CAST(t AS INTEGER) + 1, 1))) AS n
  FROM (SELECT DISTINCT taxa FROM parts), li_patterns GROUP BY taxa)
SELECT array_to_string(taxa, ',') AS taxa, count(*) AS n_components, CAST(sum(n) AS BIGINT) AS n_columns
FROM parts JOIN cut USING (taxa) GROUP BY ALL"""


def log_prior(spark, sf):
    return prior_of_trees(T.customer_forest(spark, sf), 20.0).select(
        "tree_id", rounded("log_prior").alias("log_prior")
    )


def merge_type(kind):
    """One merge on components made of event patterns and fixed edges."""

    def run(spark, sf):
        from cladeloom.functions.codes import allows

        patterns, _ = event_patterns(spark, sf)
        patterns = materialize(patterns, "patterns")
        jc = JukesCantor()

        def clade(taxon, t):
            state = [allows(F.substring("pattern", taxon + 1, 1), b) for b in "ACGT"]
            up = jc.message(state, F.lit(t))
            return patterns.select("pattern_id", F.posexplode(F.array(*up)).alias("i", "value"))

        def edge(t):
            rows = [(i, j, float(jc.matrices([t])[0][i, j])) for i in range(4) for j in range(4)]
            cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                       F.lit(v).alias("value")) for i, j, v in rows])
            return patterns.select("pattern_id", F.explode(cells).alias("c")).select(
                "pattern_id", "c.i", "c.j", "c.value")

        if kind == 1:
            out = merge_long(1, clade(0, 0.1), clade(1, 0.2))
        elif kind == 2:
            out = merge_long(2, clade(0, 0.1), edge(0.3))
        elif kind == 3:
            out = merge_long(3, edge(0.3), clade(1, 0.2))
        elif kind == 4:
            out = merge_long(4, merge_long(2, clade(0, 0.1), edge(0.3)), clade(2, 0.15))
        else:
            out = merge_long(5, merge_long(2, clade(0, 0.1), edge(0.3)),
                             merge_long(3, edge(0.25), clade(3, 0.2)))
        keys = ["pattern_id", "i"] + (["j"] if "j" in out.columns else [])
        return out.select(*keys, rounded("value", 9).alias("value"))

    return run


# --- SQL --------------------------------------------------------------------


def _parse(text):
    """Nested (children, label, length) of a fixed tree, for unrolled SQL."""
    import re

    stack, done = [[]], None
    for tok in re.findall(r"[(),;]|[^(),;]+", text):
        if tok == "(":
            stack.append([])
        elif tok == ")":
            done = stack.pop()
            stack[-1].append([done, "", "0"])
        elif tok not in ",;":
            label, _, length = tok.partition(":")
            if stack[-1] and stack[-1][-1][0] is done and done is not None and not label:
                stack[-1][-1][2] = length
            else:
                stack[-1].append([[], label, length])
                done = None
        if tok == ",":
            done = None
    return stack[0][0]


def _jc_rows(t):
    decay = f"exp(-4.0 * ({t}) / 3)"
    return [f"(0.25 - 0.25 * {decay}) * (x0 + x1 + x2 + x3) + {decay} * x{i}" for i in range(4)]


def _hky_rows(t):
    rate = "(1.0 / (2 * 0.5 * 0.5 + 2 * 2.0 * (0.3 * 0.2 + 0.2 * 0.3)))"
    rows = []
    for i in range(4):
        terms = []
        for j in range(4):
            if (i + j) % 2:
                p = f"{PI[j]} * (1 - exp(-{rate} * {t}))"
            else:
                p = (f"{PI[j]} + {PI[j]} * exp(-{rate} * {t}) + ({int(i == j)} - {PI[j]} / 0.5) "
                     f"* exp(-{rate} * {t} * (1 + 0.5 * (2.0 - 1)))")
            terms.append(f"({p}) * x{j}")
        rows.append(" + ".join(terms))
    return rows


_STATES = "states(sym, x0, x1, x2, x3) AS (VALUES " + ", ".join(
    f"('{s}', {', '.join(f'{float(k == int(s, 16) or s == chr(101))}::DOUBLE' for k in range(4))})"
    for s in "0123e"
) + ")"


def unrolled(tree, taxa, source, keys, rows_of=_jc_rows, pi=(0.25,) * 4, factor="1"):
    """CTE text and root CTE name scoring ``source`` (keys, pattern) on a fixed tree."""
    ctes = []

    def visit(node, edges):
        children, label, length = node
        t = f"({length} * {factor})"
        name = f"n{len(edges)}"
        edges.append(name)
        if not children:
            k = [str(x) for x in taxa].index(label) + 1
            body = (f"SELECT {keys}, x0, x1, x2, x3 FROM {source} "
                    f"JOIN states ON substr(pattern, {k}, 1) = sym")
        else:
            a, b = (visit(c, edges) for c in children)
            body = (f"SELECT {keys}, " + ", ".join(f"{a}.y{i} * {b}.y{i} AS x{i}" for i in range(4))
                    + f" FROM {a} JOIN {b} USING ({keys})")
        up = ", ".join(f"{r} AS y{i}" for i, r in enumerate(rows_of(t)))
        ctes.append(f"{name} AS (SELECT {keys}, x0, x1, x2, x3, {up} FROM ({body}))")
        return name

    root = visit(tree, [])
    mean = " + ".join(f"{p} * x{i}" for i, p in enumerate(pi))
    return ", ".join([_STATES, *ctes]), f"(SELECT {keys}, ln({mean}) AS loglik FROM {root})"


_T5_CTES, _T5_ROOT = unrolled(_parse(T5), EVENT_TAXA, "ev_patterns", "pattern_id")
_EVENT_LOGLIK = f"""
WITH {EVENT_SITES}, {_T5_CTES}
SELECT pattern_id, freq, {sql_round("loglik")} AS loglik
FROM {_T5_ROOT} JOIN ev_patterns USING (pattern_id)"""
_T7_CTES, _T7_ROOT = unrolled(_parse(T7), range(1, 8), "li_patterns", "pattern_id", _hky_rows, PI)
_LINE_LOGLIK = f"""
WITH {LINE_SITES}, {_T7_CTES}
SELECT pattern_id, freq, {sql_round("loglik")} AS loglik
FROM {_T7_ROOT} JOIN li_patterns USING (pattern_id)"""
def _gtr_rows(t):
    return [" + ".join(f"(SELECT p FROM gtr WHERE i = {i} AND j = {j} AND t = round({t}, 9)) * x{j}" for j in range(4))
            for i in range(4)]


_GTR_CTES, _GTR_ROOT = unrolled(_parse(T7), range(1, 8), "li_patterns", "pattern_id", _gtr_rows, GTR.pi)
_LINE_GTR = f"""
WITH RECURSIVE {LINE_SITES}, {series_sql("SELECT round(unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]), 9) AS t")}, {_GTR_CTES}
SELECT pattern_id, freq, {sql_round("loglik")} AS loglik
FROM {_GTR_ROOT} JOIN li_patterns USING (pattern_id)"""
_NATION = f"""
WITH {EVENT_SITES},
scored AS (SELECT CAST(n_nationkey AS BIGINT) AS tree_id, (1 + n_nationkey % 7)::DOUBLE / 4 AS f,
                  pattern_id, pattern FROM nation, ev_patterns),
"""
_N_CTES, _N_ROOT = unrolled(
    _parse(T5), EVENT_TAXA, "scored", "tree_id, f, pattern_id", factor="f")


def _updates_sql():
    """One unrolled score per edge; edges numbered leaves first, each in postorder."""
    parts = []
    leaves, inner = [], []

    def number(node, top):
        for c in node[0]:
            number(c, False)
        if not top:
            (inner if node[0] else leaves).append(node)

    base = _parse(T5)
    number(base, True)
    for comp, node in enumerate(leaves + inner):
        kept = node[2]
        node[2] = f"({kept} + 0.1)"
        ctes, root = unrolled(base, EVENT_TAXA, "ev_patterns", "pattern_id")
        node[2] = kept
        parts.append(f"SELECT CAST({comp} AS BIGINT) AS comp_id, pattern_id, "
                     f"{sql_round('loglik')} AS loglik FROM (WITH {ctes} SELECT * FROM {root})")
    return f"WITH {EVENT_SITES} " + " UNION ALL ".join(parts)


_MERGE_BASE = f"""
WITH {EVENT_SITES}, {_STATES},
idx AS (SELECT CAST(range AS INTEGER) AS i FROM range(4)),
edge AS (SELECT t, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0.25 + 0.75 * exp(-4.0 * t / 3)
           ELSE 0.25 - 0.25 * exp(-4.0 * t / 3) END AS p
         FROM (VALUES (0.1::DOUBLE), (0.15), (0.2), (0.25), (0.3)) AS v(t), idx a, idx b),
leaf AS (SELECT pattern_id, k, t, e.i,
    sum(e.p * CASE e.j WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END) AS v
  FROM ev_patterns, (VALUES (0, 0.1::DOUBLE), (1, 0.2), (2, 0.15), (3, 0.2)) AS w(k, tt),
       states, edge e WHERE substr(pattern, k + 1, 1) = sym AND e.t = tt GROUP BY ALL),
c0 AS (SELECT pattern_id, i, v FROM leaf WHERE k = 0), c1 AS (SELECT pattern_id, i, v FROM leaf WHERE k = 1),
c2 AS (SELECT pattern_id, i, v FROM leaf WHERE k = 2), c3 AS (SELECT pattern_id, i, v FROM leaf WHERE k = 3),
m2 AS (SELECT pattern_id, c0.i, e.j, v * p AS v FROM c0 JOIN edge e ON e.i = c0.i AND e.t = 0.3),
m3 AS (SELECT pattern_id, e.i, e.j, v * p AS v FROM c1 JOIN edge e ON e.j = c1.i AND e.t = 0.3),
m3b AS (SELECT pattern_id, e.i, e.j, v * p AS v FROM c3 JOIN edge e ON e.j = c3.i AND e.t = 0.25)
"""
_MERGES = {
    1: "SELECT pattern_id, i, {v} AS value FROM (SELECT pattern_id, i, c0.v * c1.v AS v FROM c0 JOIN c1 USING (pattern_id, i))",
    2: "SELECT pattern_id, i, j, {v} AS value FROM m2",
    3: "SELECT pattern_id, i, j, {v} AS value FROM m3",
    4: "SELECT pattern_id, i, {v} AS value FROM (SELECT m2.pattern_id, m2.i, sum(m2.v * c2.v) AS v "
       "FROM m2 JOIN c2 ON m2.pattern_id = c2.pattern_id AND m2.j = c2.i GROUP BY ALL)",
    5: "SELECT pattern_id, i, j, {v} AS value FROM (SELECT m2.pattern_id, m2.i, m3b.j, sum(m2.v * m3b.v) AS v "
       "FROM m2 JOIN m3b ON m2.pattern_id = m3b.pattern_id AND m2.j = m3b.i GROUP BY ALL)",
}

_STAR_UP = ", ".join(
    f"ln((0.25 - 0.25 * e) * (exp(s0 - m) + exp(s1 - m) + exp(s2 - m) + exp(s3 - m)) "
    f"+ e * exp(s{i} - m)) + m AS u{i}" for i in range(4)
)


def _star_level(name, source, node, parent, length):
    sums = ", ".join(f"sum(u{i}) AS s{i}" for i in range(4))
    return (f"{name}_s AS (SELECT site, {parent} AS k, {sums} FROM {source} GROUP BY ALL), "
            f"{name} AS (SELECT site, n.parent_id AS parent, {_STAR_UP} FROM ("
            f"SELECT *, greatest(s0, s1, s2, s3) AS m FROM {name}_s) q "
            f"JOIN (SELECT node_id, parent_id, exp(-4.0 * length / 3) AS e FROM nodes) n ON q.k = n.node_id)")


_STAR = f"""
WITH {SUPPLIER_TREE},
cells AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS site, l_suppkey,
    CAST(floor(max(l_extendedprice)) AS BIGINT) % 4 AS b FROM lineitem GROUP BY ALL),
up0 AS (SELECT site, parent_id AS parent, {", ".join(
    f"ln(0.25 - 0.25 * e + CASE WHEN b = {i} THEN e ELSE 0 END) AS u{i}" for i in range(4))}
  FROM cells JOIN (SELECT *, exp(-4.0 * length / 3) AS e FROM nodes) n ON n.node_id = 3 * {T.LEVEL} + l_suppkey),
{_star_level("nation_up", "up0", "node_id", "parent", "length")},
{_star_level("region_up", "nation_up", "node_id", "parent", "length")},
top AS (SELECT site, sum(u0) AS s0, sum(u1) AS s1, sum(u2) AS s2, sum(u3) AS s3 FROM region_up GROUP BY site)
SELECT CAST(site AS BIGINT) AS site,
  {sql_round("greatest(s0,s1,s2,s3) + ln(0.25 * (exp(s0 - greatest(s0,s1,s2,s3)) + exp(s1 - greatest(s0,s1,s2,s3)) + exp(s2 - greatest(s0,s1,s2,s3)) + exp(s3 - greatest(s0,s1,s2,s3))))")} AS loglik
FROM top"""

QUERIES = {
    "site_loglik_pruning": Query(site_loglik_pruning, _EVENT_LOGLIK),
    "site_loglik_pruning_plan": Query(site_loglik_blocks("pruning"), _EVENT_LOGLIK),
    "site_loglik_balanced": Query(site_loglik_blocks("balanced"), _EVENT_LOGLIK),
    "site_loglik_hky_balanced": Query(site_loglik_lineitem("blocks"), _LINE_LOGLIK),
    "site_loglik_hky_grid": Query(site_loglik_lineitem("grid"), _LINE_LOGLIK),
    "site_loglik_hky_pruning": Query(site_loglik_hky_joins, _LINE_LOGLIK),
    "site_loglik_hky_layers": Query(site_loglik_layers, _LINE_LOGLIK),
    "loglik_total": Query(
        loglik_total,
        f"WITH {EVENT_SITES}, {_T5_CTES} SELECT {sql_round('sum(freq * loglik)')} AS loglik "
        f"FROM {_T5_ROOT} JOIN ev_patterns USING (pattern_id)"),
    "batch_scores": Query(
        batch_scores,
        f"""{_NATION} {_N_CTES}
SELECT tree_id, CAST(5 AS BIGINT) AS ntax, {sql_round("f * 0.55")} AS root_to_tip,
  {sql_round("f * 1.35")} AS total_length,
  CAST(sum(freq) AS BIGINT) AS n_sites, count(*) AS n_patterns,
  CAST(5 AS BIGINT) AS pruning_height, CAST(4 AS BIGINT) AS balanced_height,
  {sql_round("sum(freq * loglik)", 4)} AS loglik_pruning,
  {sql_round("sum(freq * loglik)", 4)} AS loglik_balanced
FROM {_N_ROOT} JOIN ev_patterns USING (pattern_id) GROUP BY tree_id, f"""),
    "batch_scores_grid": Query(
        batch_scores_grid,
        f"{_NATION} {_N_CTES} SELECT tree_id, {sql_round('sum(freq * loglik)', 4)} AS loglik "
        f"FROM {_N_ROOT} JOIN ev_patterns USING (pattern_id) GROUP BY tree_id"),
    "loglik_fk_star": Query(loglik_fk_star, _STAR),
    "branch_update_loglik": Query(branch_update("balanced"), _updates_sql()),
    "branch_update_pruning": Query(branch_update("pruning"), _updates_sql()),
    "site_loglik_shared": Query(site_loglik_shared, _LINE_LOGLIK),
    "site_loglik_gtr": Query(site_loglik_gtr, _LINE_GTR),
    "site_loglik_consed": Query(site_loglik_consed, _LINE_LOGLIK),
    "subpattern_counts": Query(subpattern_counts, _SUBPATTERNS),
    "log_prior_forest": Query(
        log_prior,
        f"WITH {FOREST} SELECT tree_id, {sql_round('sum(ln(20.0) - 20.0 * length)')} AS log_prior "
        "FROM nodes WHERE parent_id IS NOT NULL GROUP BY tree_id"),
    **{
        f"merge_type{k}": Query(merge_type(k), _MERGE_BASE + body.format(v=sql_round("v", 9)))
        for k, body in _MERGES.items()
    },
}
