"""Name matching and string functions."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from cladeloom.functions import names as N
from cladeloom.operators import trees as O
from cladeloom.operators.names import match_names
from cladeloom.programs import tidy_trees
from cladeloom.queries.base import Query
from cladeloom.queries.trees import SUPPLIER_TREE
from cladeloom.sources import tables as T
from cladeloom.sources.newick import to_newick


def _perturbed(name, key):
    """Unchanged, other punctuation, upper case, or a changed and longer name."""
    return (
        F.when(key % 4 == 0, name)
        .when(key % 4 == 1, F.regexp_replace(name, "#", "-_"))
        .when(key % 4 == 2, F.upper(name))
        .otherwise(F.concat(F.regexp_replace(name, "00", "0x"), F.lit("y")))
    )


_PERTURBED = """CASE {key} % 4 WHEN 0 THEN {name} WHEN 1 THEN replace({name}, '#', '-_')
  WHEN 2 THEN upper({name}) ELSE replace({name}, '00', '0x') || 'y' END"""


def name_match(table, key, name):
    def run(spark, sf):
        t = T.read_table(spark, sf, table)
        candidates = t.select(F.col(key).alias("idx"), F.col(name).alias("name"))
        queries = t.select(_perturbed(F.col(name), F.col(key)).alias("query"))
        return match_names(queries, candidates)

    return run


def _match_sql(table, key, name):
    return f"""
WITH cand AS (SELECT {key} AS idx, {name} AS name FROM {table}),
q AS (SELECT DISTINCT {_PERTURBED.format(key=key, name=name)} AS query FROM {table}),
folded AS (
  SELECT query,
    (SELECT min(idx) FROM cand WHERE name = query) AS i0,
    (SELECT min(idx) FROM cand WHERE regexp_replace(name, '[[:punct:]]', '', 'g')
                                   = regexp_replace(query, '[[:punct:]]', '', 'g')) AS i1,
    (SELECT min(idx) FROM cand WHERE lower(name) = lower(query)) AS i2 FROM q),
pairs AS (
  SELECT query, idx, greatest(length(query), length(name)) - (
    SELECT count(*) FROM range(1, 1 + least(length(query), length(name))) r(p)
    WHERE substr(query, CAST(p AS INTEGER), 1) = substr(name, CAST(p AS INTEGER), 1)) AS d
  FROM folded, cand WHERE coalesce(i0, i1, i2) IS NULL),
near AS (SELECT query, idx, d, row_number() OVER (PARTITION BY query ORDER BY d, idx) AS r FROM pairs)
SELECT query, coalesce(i0, i1, i2) AS idx,
  CASE WHEN i0 IS NOT NULL THEN 'exact' WHEN i1 IS NOT NULL THEN 'punctuation' ELSE 'case' END AS kind,
  CAST(0 AS BIGINT) AS distance FROM folded WHERE coalesce(i0, i1, i2) IS NOT NULL
UNION ALL SELECT query, idx, 'distance', CAST(d AS BIGINT) FROM near WHERE r = 1"""


def name_folding(spark, sf):
    docs = T.read_table(spark, sf, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        F.md5(N.strip_punctuation(F.col("text"))).alias("stripped_md5"),
        F.md5(N.lower_ascii(F.col("text"))).alias("lower_md5"),
    )


def name_distance(spark, sf):
    part = T.read_table(spark, sf, "part")
    return part.select(
        "p_partkey", N.name_distance(F.col("p_name"), F.col("p_type")).alias("distance")
    )


def file_stem(spark, sf):
    pages = T.read_table(spark, sf, "pages")
    return pages.select("page_id", N.file_stem(F.col("url")).alias("stem"))


def newick_fk(spark, sf):
    return to_newick(O.number_nodes(T.supplier_tree(spark, sf)))


def tidy_tree(spark, sf):
    """Supplier tree with perturbed leaf names, matched back to the suppliers."""
    nodes = O.number_nodes(T.supplier_tree(spark, sf))
    key = F.col("node_id") % T.LEVEL
    nodes = nodes.withColumn(
        "label", F.when(F.col("is_leaf"), _perturbed(F.col("label"), key)).otherwise(F.col("label"))
    )
    taxa = T.read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("taxon_id"), F.col("s_name").alias("taxon")
    )
    return tidy_trees(nodes, taxa)


def _newick_sql(region, nation):
    return f"""
WITH {SUPPLIER_TREE},
s AS (SELECT parent_id, string_agg(label || ':' || CAST(length AS VARCHAR), ',' ORDER BY node_id) AS t
      FROM nodes WHERE depth = 3 GROUP BY 1),
n AS (SELECT n.parent_id, string_agg('(' || t || ')' || {nation} || ':' || CAST(length AS VARCHAR), ',' ORDER BY node_id) AS t
      FROM nodes n JOIN s ON s.parent_id = n.node_id GROUP BY 1),
r AS (SELECT string_agg('(' || t || ')' || {region} || ':' || CAST(length AS VARCHAR), ',' ORDER BY node_id) AS t
      FROM nodes r JOIN n ON n.parent_id = r.node_id)
SELECT CAST(0 AS BIGINT) AS tree_id, '(' || t || ')' || {"'root'" if region != "''" else "''"} || ':0.0' AS newick FROM r"""


QUERIES = {
    "name_match_suppliers": Query(
        name_match("supplier", "s_suppkey", "s_name"), _match_sql("supplier", "s_suppkey", "s_name")),
    "name_match_customers": Query(
        name_match("customer", "c_custkey", "c_name"), _match_sql("customer", "c_custkey", "c_name")),
    "name_folding": Query(
        name_folding,
        "SELECT doc_id, md5(regexp_replace(text, '[[:punct:]]', '', 'g')) AS stripped_md5, "
        f"md5(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS lower_md5 "
        "FROM documents"),
    "name_distance": Query(
        name_distance,
        """SELECT p_partkey, CAST(greatest(length(p_name), length(p_type)) - (
  SELECT count(*) FROM range(1, 1 + least(length(p_name), length(p_type))) r(p)
  WHERE substr(p_name, CAST(p AS INTEGER), 1) = substr(p_type, CAST(p AS INTEGER), 1)) AS BIGINT) AS distance
FROM part"""),
    "file_stem": Query(
        file_stem,
        r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem
FROM pages"""),
    "newick_fk": Query(newick_fk, _newick_sql("r.label", "n.label")),
    "tidy_tree_fk": Query(tidy_tree, _newick_sql("''", "''")),
}
