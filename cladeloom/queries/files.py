"""Derived alignments, trees and tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import patterns as P
from cladeloom.operators import trees as O
from cladeloom.operators.ranking import global_rank
from cladeloom.queries.base import LINE_SITES, Query, rounded, sql_round
from cladeloom.queries.trees import FOREST, SUPPLIER_TREE
from cladeloom.session import materialize, scratch_path
from cladeloom.sources import newick as X
from cladeloom.sources import tables as T
from cladeloom.sources.phylip import align_to_taxa, read_phylip, write_phylip
from cladeloom.sources.tsv import read_tsv, write_tsv


def supplier_alignment(spark, sf):
    """Rows (taxon_id, taxon, symbols): suppliers over the range of ship months."""
    cells = T.supplier_cells(spark, sf)
    span = cells.agg(F.min("site").alias("lo"), F.max("site").alias("hi")).first()
    rows = cells.groupBy("taxon").agg(
        F.map_from_entries(F.collect_list(F.struct("site", "symbol"))).alias("m")
    )
    symbols = F.array_join(
        F.transform(F.sequence(F.lit(span.lo), F.lit(span.hi)), lambda s: F.coalesce(F.element_at("m", s), F.lit("e"))),
        "",
    )
    return rows.select(
        F.col("taxon").alias("taxon_id"),
        F.concat(F.lit("S"), F.col("taxon").cast("string")).alias("taxon"),
        symbols.alias("symbols"),
    )


def _written_alignment(spark, sf):
    path = scratch_path(spark, "phylip")
    write_phylip(supplier_alignment(spark, sf), path)
    return read_phylip(spark, path, per_file=False)


def phylip_rows(spark, sf):
    return _written_alignment(spark, sf).select("taxon_id", "taxon", "symbols", "n_sites")


def phylip_named(spark, sf):
    """The same file read against known taxa: ids come from the supplier table."""
    taxa = T.read_table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1000).alias("taxon_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("taxon"),
    )
    return align_to_taxa(_written_alignment(spark, sf), taxa).select("taxon_id", "taxon")


def phylip_patterns(spark, sf):
    """Alignment file to site patterns through the block transpose."""
    alignment = _written_alignment(spark, sf)
    size = alignment.agg(F.count("*").alias("n"), F.max("n_sites").alias("w")).first()
    return P.compress(P.transpose(alignment, size.n, size.w))


def newick_roundtrip(spark, sf):
    path = scratch_path(spark, "newick")
    X.write_newick(X.to_newick(O.number_nodes(T.supplier_tree(spark, sf))), path)
    trees = X.read_newick_text(spark, path).withColumn("tree_id", F.col("tree_number"))
    return X.parse_newick(trees).select(
        "tree_id", "label", F.col("depth").cast("bigint").alias("depth"),
        rounded("length").alias("length"), "is_leaf", "pre", "post",
    )


def newick_rejects(spark, sf):
    """Trees read and rejected: whole ones in one folder, trees cut in half in another, and a folder that is not there."""
    texts = materialize(X.to_newick(O.number_nodes(T.customer_forest(spark, sf))), "texts")
    half = F.substring("newick", F.lit(1), (F.length("newick") / 2).cast("int"))
    cut = F.col("tree_id") % 5 == 0
    folders = {kind: scratch_path(spark, f"newick_{kind}") for kind in ("whole", "half", "absent")}
    X.write_newick(texts.filter(~cut), folders["whole"])
    X.write_newick(texts.filter(cut).select("tree_id", half.alias("newick")), folders["half"])
    nodes, rejects = X.read_trees(spark, list(folders.values()))
    kind = F.regexp_extract("file", "newick_([a-z]+)-", 1).alias("kind")
    read = nodes.select("tree_id.file", "tree_id.tree_number").select(kind, F.lit("read").alias("state"), "file", "tree_number")
    bad = rejects.select(kind, F.col("reason").alias("state"), "file", "tree_number")
    return read.unionByName(bad).groupBy("kind", "state").agg(
        F.count_distinct(F.struct("file", "tree_number")).alias("n_trees"), F.count("*").alias("n_rows"))


def newick_new_taxa(spark, sf):
    """Leaves of the supplier tree, numbered behind the known third of them in the order of the text."""
    tree = materialize(O.number_nodes(T.supplier_tree(spark, sf)), "numbered")
    known = global_rank(tree.filter("is_leaf AND node_id % 3 = 0").select(F.col("label").alias("taxon")), [F.col("taxon")], "taxon_id")
    nodes = X.parse_newick(X.to_newick(tree))
    named, taxa = X.attach_new_taxa(nodes, known)
    return named.filter("is_leaf").select("label", "taxon_id")


def newick_forest(spark, sf):
    """Every customer's tree through text files: leaves and lengths survive."""
    path = scratch_path(spark, "newick")
    X.write_newick(X.to_newick(O.number_nodes(T.customer_forest(spark, sf))), path)
    trees = X.read_newick_text(spark, path).withColumn("tree_id", F.struct("file", "tree_number"))
    nodes = X.parse_newick(trees)
    return nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("parent_id").isNull(), F.col("label"))).alias("root"),
        F.sum(F.col("is_leaf").cast("bigint")).alias("n_leaves"),
        rounded(F.sum("length")).alias("total_length"),
    ).drop("tree_id")


def tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "tsv")
    write_tsv(P.compress(T.lineitem_sites(spark, sf)), path)
    return read_tsv(spark, path, "pattern string, freq bigint")


_ALIGNMENT = """
cells AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS site, l_suppkey AS taxon,
    CAST(CAST(floor(max(l_extendedprice)) AS BIGINT) % 4 AS VARCHAR) AS sym FROM lineitem GROUP BY ALL),
sites AS (SELECT unnest(range((SELECT min(site) FROM cells), (SELECT max(site) + 1 FROM cells))) AS site),
taxa AS (SELECT DISTINCT taxon FROM cells),
grid AS (SELECT t.taxon, s.site, coalesce(c.sym, 'e') AS sym
         FROM taxa t CROSS JOIN sites s LEFT JOIN cells c ON c.taxon = t.taxon AND c.site = s.site)
"""

QUERIES = {
    "phylip_rows": Query(
        phylip_rows,
        f"""WITH {_ALIGNMENT}, r AS (SELECT taxon, string_agg(sym, '' ORDER BY site) AS symbols FROM grid GROUP BY taxon)
SELECT row_number() OVER (ORDER BY taxon) - 1 AS taxon_id, 'S' || CAST(taxon AS VARCHAR) AS taxon, symbols,
  (SELECT count(*) FROM sites) AS n_sites FROM r"""),
    "phylip_named": Query(
        phylip_named,
        f"WITH {_ALIGNMENT} SELECT taxon + 1000 AS taxon_id, 'S' || CAST(taxon AS VARCHAR) AS taxon FROM taxa"),
    "phylip_patterns": Query(
        phylip_patterns,
        f"""WITH {_ALIGNMENT}, c AS (SELECT site, string_agg(sym, '' ORDER BY taxon) AS pattern FROM grid GROUP BY site)
SELECT pattern, count(*) AS freq FROM c GROUP BY pattern"""),
    "newick_roundtrip_fk": Query(
        newick_roundtrip,
        f"""WITH {SUPPLIER_TREE}
SELECT CAST(1 AS BIGINT) AS tree_id, replace(label, ' ', '') AS label, CAST(depth AS BIGINT) AS depth,
  {sql_round("length")} AS length, is_leaf, pre, post FROM walk"""),
    "newick_rejects": Query(
        newick_rejects,
        f"""WITH {FOREST}
SELECT CASE WHEN tree_id % 5 = 0 THEN 'half' ELSE 'whole' END AS kind, CASE WHEN tree_id % 5 = 0 THEN 'malformed' ELSE 'read' END AS state,
  count(DISTINCT tree_id) AS n_trees, count(*) FILTER (tree_id % 5 <> 0 OR parent_id IS NULL) AS n_rows
FROM nodes GROUP BY ALL UNION ALL SELECT 'absent', 'cannot be read', 1, 1"""),
    "newick_new_taxa": Query(
        newick_new_taxa,
        f"""WITH {SUPPLIER_TREE},
known AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS taxon_id FROM walk WHERE is_leaf AND node_id % 3 = 0),
new AS (SELECT label, (SELECT count(*) FROM known) + row_number() OVER (ORDER BY pre) - 1 AS taxon_id
  FROM walk WHERE is_leaf AND node_id % 3 <> 0)
SELECT label, taxon_id FROM known UNION ALL SELECT label, taxon_id FROM new"""),
    "newick_roundtrip_forest": Query(
        newick_forest,
        f"""WITH {FOREST} SELECT 'C' || CAST(tree_id AS VARCHAR) AS root,
  count(*) FILTER (WHERE is_leaf) AS n_leaves, {sql_round("sum(length)")} AS total_length
FROM nodes GROUP BY tree_id"""),
    "tsv_roundtrip": Query(
        tsv_roundtrip, f"WITH {LINE_SITES} SELECT pattern, freq FROM li_patterns"),
}
