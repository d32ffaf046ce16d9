"""Site patterns of alignments derived from events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import codes
from cladeloom.operators import patterns as P
from cladeloom.operators.ranking import with_previous
from cladeloom.operators.tour import spanning_tree, tour_order
from cladeloom.queries.base import EVENT_SITES, LINE_SITES, Query, rounded, sql_round
from cladeloom.session import materialize
from cladeloom.sources import tables as T


def pattern_counts_events(spark, sf):
    return P.compress(T.event_sites(spark, sf))


def pattern_counts_lineitem(spark, sf):
    return P.compress(T.lineitem_sites(spark, sf))


def patterns_uncompressed(spark, sf):
    return P.uncompressed(T.event_sites(spark, sf)).select(
        "user_id", F.col("day").cast("string").alias("day"), "pattern", "freq"
    )


def pattern_lex_rank(spark, sf):
    return P.compress_patterns(T.lineitem_sites(spark, sf), "lex")


def pattern_zigzag_rank(spark, sf):
    return P.compress_patterns(T.lineitem_sites(spark, sf), "zigzag")


def pattern_diffs(spark, sf):
    return P.pattern_diffs(P.compress_patterns(T.event_sites(spark, sf)))


def pattern_diffs_zigzag(spark, sf):
    return P.pattern_diffs(P.compress_patterns(T.lineitem_sites(spark, sf), "zigzag"))


def hamming_neighbours(spark, sf):
    ordered = P.compress_patterns(T.lineitem_sites(spark, sf))
    return (
        with_previous(ordered.select("pattern_id", "pattern"), "pattern_id", ["pattern"])
        .filter("prev_pattern is not null")
        .select("pattern_id", P.hamming(F.col("pattern"), F.col("prev_pattern")).alias("distance"))
    )


def path_length(method):
    def run(spark, sf):
        out = P.path_length(P.compress_patterns(T.lineitem_sites(spark, sf), method))
        return out.select(
            "n_sites", "n_patterns", "path_length",
            rounded("avg_site_distance").alias("avg_site_distance"),
            rounded("avg_pattern_distance").alias("avg_pattern_distance"),
        )

    return run


def base_composition(spark, sf):
    """Letters per taxon, counted on patterns and weighted by their frequency."""
    pats = P.compress(T.lineitem_sites(spark, sf))
    cells = pats.select(
        "freq", F.posexplode(F.split("pattern", "")).alias("taxon_id", "symbol")
    )
    return cells.groupBy(
        F.col("taxon_id").cast("bigint").alias("taxon_id"),
        codes.letters_from_symbols(F.col("symbol")).alias("letter"),
    ).agg(F.sum("freq").alias("n"))


def ambiguity_expand(spark, sf):
    """All 15 states, taken from quantities modulo 15, with the bases they allow."""
    li = T.read_table(spark, sf, "lineitem")
    symbol = codes.symbol_of_code(F.floor("l_quantity").cast("bigint") % 15)
    counted = li.select(symbol.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    vector = codes.state_vector(F.col("symbol"))
    return counted.select(
        codes.letters_from_symbols(F.col("symbol")).alias("letter"),
        codes.code_of_symbol(F.col("symbol")).cast("bigint").alias("code"),
        *[vector[k].alias(f"may_be_{b.lower()}") for k, b in enumerate("ACGT")],
        "n",
    )


def decode_documents(spark, sf):
    """Nucleotide letters of whole texts, decoded and re-printed."""
    docs = T.read_table(spark, sf, "documents").select("doc_id", "text")
    kept = F.regexp_replace("text", "[^ACGTURYSWKMDVHBNXacgturyswkmdvhbnx?-]", "")
    symbols = codes.symbols_from_letters(kept)
    decoded = docs.select("doc_id", symbols.alias("s"))
    return decoded.select(
        "doc_id",
        F.length("s").cast("bigint").alias("n_letters"),
        F.md5("s").alias("symbols_md5"),
        F.md5(codes.letters_from_symbols(F.col("s"))).alias("letters_md5"),
    )


def tour(spark, sf):
    return tour_order(P.compress(T.event_sites(spark, sf)))


def tour_path(spark, sf):
    return P.path_length(tour_order(P.compress(T.lineitem_sites(spark, sf))))


def tour_summary(spark, sf):
    """Size and quality of the tour: a permutation of all patterns, at most twice the tree's weight."""
    patterns = P.compress(T.event_sites(spark, sf))
    tree = spanning_tree(patterns)[1].agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("tree_weight"))
    ordered = materialize(tour_order(patterns), "tour")
    ids = ordered.agg(F.count_distinct("pattern").alias("n_patterns"), F.sum("freq").alias("n_sites"),
                      (F.max("pattern_id") + 1).alias("n_places"), F.count_distinct("pattern_id").alias("n_ids"),
                      F.min_by("pattern", "pattern_id").alias("first_pattern"))
    length = P.path_length(ordered).select("path_length")
    both = ids.crossJoin(tree).crossJoin(length)  # one row each
    return both.select("n_patterns", "n_sites", "n_places", "n_ids", "first_pattern", "tree_weight",
                       (F.col("path_length") <= 2 * F.col("tree_weight")).alias("within_bound"))


# A spanning tree of least weight has one edge less than there are components at every distance below its edges.
_TOUR_SUMMARY = f"""
WITH RECURSIVE {EVENT_SITES},
near AS (SELECT a.pattern_id AS x, b.pattern_id AS y, hamming(a.pattern, b.pattern) AS w
  FROM ev_patterns a, ev_patterns b WHERE a.pattern_id <> b.pattern_id),
reach(w, id, comp) USING KEY (w, id) AS (
  SELECT w, pattern_id, pattern_id FROM ev_patterns, range(0, 6) t(w)
  UNION SELECT w, id, comp FROM (
    SELECT r.w, n.y AS id, min(r.comp) AS comp FROM reach r JOIN near n ON n.x = r.id AND n.w <= r.w GROUP BY ALL) step
  WHERE EXISTS (SELECT 1 FROM recurring.reach k WHERE k.w = step.w AND k.id = step.id AND step.comp < k.comp)),
weight AS (SELECT sum(c - 1) AS tree_weight FROM (SELECT w, count(DISTINCT comp) AS c FROM reach GROUP BY w))
SELECT count(*) AS n_patterns, CAST(sum(freq) AS BIGINT) AS n_sites, count(*) AS n_places, count(*) AS n_ids,
  min(pattern) AS first_pattern, CAST(any_value(tree_weight) AS BIGINT) AS tree_weight, true AS within_bound
FROM ev_patterns, weight"""


_ZIGZAG = " || ".join(
    f"translate(substr(pattern, {k}, 1), '0123456789abcde', 'edcba9876543210')"
    if k % 2 == 0 else f"substr(pattern, {k}, 1)"
    for k in range(1, 8)
)
_LI_ZIGZAG = f"""{LINE_SITES}, ordered AS (
  SELECT pattern, freq, row_number() OVER (ORDER BY {_ZIGZAG}) - 1 AS pattern_id FROM li_patterns)"""


def _diff_sql(ctes, table, n):
    return f"""
WITH {ctes}, p AS (
  SELECT pattern_id, pattern, lag(pattern) OVER (ORDER BY pattern_id) AS prev FROM {table}),
pos AS (SELECT CAST(range AS BIGINT) AS taxon_id FROM range({n}))
SELECT pattern_id, taxon_id, substr(pattern, CAST(taxon_id + 1 AS INTEGER), 1) AS symbol
FROM p, pos
WHERE prev IS NULL
   OR substr(pattern, CAST(taxon_id + 1 AS INTEGER), 1) <> substr(prev, CAST(taxon_id + 1 AS INTEGER), 1)"""


_DISTANCE = " + ".join(
    f"CAST(substr(pattern, {k}, 1) <> substr(prev, {k}, 1) AS BIGINT)" for k in range(1, 8)
)


def _path_sql(ctes, table):
    return f"""
WITH {ctes}, p AS (
  SELECT pattern_id, pattern, freq, lag(pattern) OVER (ORDER BY pattern_id) AS prev FROM {table}),
t AS (SELECT CAST(sum(freq) AS BIGINT) AS n_sites, count(*) AS n_patterns,
             CAST(sum(coalesce({_DISTANCE}, 0)) AS BIGINT) AS path_length FROM p)
SELECT n_sites, n_patterns, path_length,
       {sql_round("path_length / (n_sites - 1)")} AS avg_site_distance,
       {sql_round("path_length / (n_patterns - 1)")} AS avg_pattern_distance
FROM t"""


_SETS = "VALUES " + ", ".join(
    f"({k}, '{codes.LETTERS[k]}', "
    + ", ".join("1.0::DOUBLE" if b in s else "0.0::DOUBLE" for b in "ACGT") + ")"
    for k, s in enumerate(codes.STATE_SETS)
)

QUERIES = {
    "pattern_counts_events": Query(
        pattern_counts_events, f"WITH {EVENT_SITES} SELECT pattern, freq FROM ev_patterns"),
    "pattern_counts_lineitem": Query(
        pattern_counts_lineitem, f"WITH {LINE_SITES} SELECT pattern, freq FROM li_patterns"),
    "patterns_uncompressed": Query(
        patterns_uncompressed,
        f"WITH {EVENT_SITES} SELECT user_id, CAST(day AS VARCHAR) AS day, pattern, "
        "CAST(1 AS BIGINT) AS freq FROM ev_sites"),
    "pattern_lex_rank": Query(
        pattern_lex_rank, f"WITH {LINE_SITES} SELECT pattern, freq, pattern_id FROM li_patterns"),
    "pattern_zigzag_rank": Query(
        pattern_zigzag_rank, f"WITH {_LI_ZIGZAG} SELECT pattern, freq, pattern_id FROM ordered"),
    "pattern_diffs": Query(pattern_diffs, _diff_sql(EVENT_SITES, "ev_patterns", 5)),
    "pattern_diffs_zigzag": Query(pattern_diffs_zigzag, _diff_sql(_LI_ZIGZAG, "ordered", 7)),
    "hamming_neighbours": Query(
        hamming_neighbours,
        f"WITH {LINE_SITES}, p AS (SELECT pattern_id, pattern, lag(pattern) OVER "
        f"(ORDER BY pattern_id) AS prev FROM li_patterns) "
        f"SELECT pattern_id, CAST({_DISTANCE} AS BIGINT) AS distance FROM p WHERE prev IS NOT NULL"),
    "path_length_lex": Query(path_length("lex"), _path_sql(LINE_SITES, "li_patterns")),
    "path_length_zigzag": Query(path_length("zigzag"), _path_sql(_LI_ZIGZAG, "ordered")),
    "base_composition": Query(
        base_composition,
        f"WITH {LINE_SITES}, pos AS (SELECT CAST(range AS BIGINT) AS taxon_id FROM range(7)) "
        "SELECT taxon_id, translate(substr(pattern, CAST(taxon_id + 1 AS INTEGER), 1), "
        f"'{codes.SYMBOLS}', '{codes.LETTERS}') AS letter, count(*) AS n "
        "FROM li_sites, pos GROUP BY ALL"),
    "ambiguity_expand": Query(
        ambiguity_expand,
        f"WITH s(code, letter, may_be_a, may_be_c, may_be_g, may_be_t) AS ({_SETS}), "
        "q AS (SELECT CAST(floor(l_quantity) AS BIGINT) % 15 AS code, count(*) AS n "
        "FROM lineitem GROUP BY 1) "
        "SELECT letter, q.code, may_be_a, may_be_c, may_be_g, may_be_t, n "
        "FROM q JOIN s ON q.code = s.code"),
    "decode_documents": Query(
        decode_documents,
        "WITH k AS (SELECT doc_id, upper(regexp_replace(text, "
        "'[^ACGTURYSWKMDVHBNXacgturyswkmdvhbnx?-]', '', 'g')) AS u FROM documents), "
        f"s AS (SELECT doc_id, translate(u, '{codes._INPUT}', '{codes._INPUT_SYMBOLS}') AS s FROM k) "
        "SELECT doc_id, length(s) AS n_letters, md5(s) AS symbols_md5, "
        f"md5(translate(s, '{codes.SYMBOLS}', '{codes.LETTERS}')) AS letters_md5 FROM s"),
    "tour_order": Query(tour),
    "tour_summary": Query(tour_summary, _TOUR_SUMMARY),
    "tour_path": Query(tour_path),
}
