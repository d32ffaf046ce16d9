"""Transition probabilities for branch lengths found in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions.models import HKY85, GeneralReversible, JukesCantor
from cladeloom.queries.base import Query, rounded, sql_round
from cladeloom.sources import tables as T

KAPPA, PI = 2.0, (0.3, 0.2, 0.2, 0.3)
GTR = GeneralReversible((1.0, 3.5, 0.7, 0.9, 4.0, 1.2), (0.3, 0.25, 0.15, 0.3))


def series_sql(lengths: str) -> str:
    """CTEs ending in gtr(t, i, j, p): the power series of the rate matrix over ``lengths`` (t). Needs WITH RECURSIVE."""
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    cells = ", ".join(f"({i}, {j}, {r}::DOUBLE)" for (i, j), r in zip(pairs, GTR.rates))
    base = ", ".join(f"({i}, {f}::DOUBLE)" for i, f in enumerate(GTR.frequencies))
    return f"""
freq(i, f) AS (VALUES {base}), half(i, j, r) AS (VALUES {cells}),
off AS (SELECT h.i, h.j, r * f AS q FROM (SELECT i, j, r FROM half UNION ALL SELECT j, i, r FROM half) h JOIN freq ON freq.i = h.j),
rate AS (SELECT sum(q * f) AS mean FROM off JOIN freq USING (i)),
gen AS (SELECT i, j, q / mean AS q FROM off, rate UNION ALL SELECT i, i, -sum(q) / any_value(mean) FROM off, rate GROUP BY i),
lengths AS ({lengths}),
term AS (SELECT 0 AS k, t, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lengths, freq a, freq b
  UNION ALL SELECT k + 1, t, term.i, gen.j, sum(v * q) * any_value(t) / (k + 1) FROM term JOIN gen ON gen.i = term.j
  WHERE k < 30 GROUP BY k, t, term.i, gen.j),
gtr AS (SELECT t, i, j, sum(v) AS p FROM term GROUP BY t, i, j)"""


def matrix(model):
    """(t, i, j, p) for every distinct discount taken as a branch length."""

    def run(spark, sf):
        li = T.read_table(spark, sf, "lineitem")
        lengths = li.select(F.round("l_discount", 2).alias("t")).distinct()
        cells = F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                     model.probability(i, j, F.col("t")).alias("p"))
            for i in range(4) for j in range(4)
        ])
        return lengths.select("t", F.explode(cells).alias("c")).select(
            rounded("t", 2).alias("t"), "c.i", "c.j", rounded("c.p", 9).alias("p")
        )

    return run


_GRID = """
WITH lengths AS (SELECT DISTINCT round(l_discount, 2) AS t FROM lineitem),
base(i, freq, kind) AS (VALUES (0, 0.3::DOUBLE, 'R'), (1, 0.2::DOUBLE, 'Y'),
                               (2, 0.2::DOUBLE, 'R'), (3, 0.3::DOUBLE, 'Y')),
pairs AS (SELECT a.i, b.i AS j, b.freq AS pj, a.kind = b.kind AS same_kind,
                 (SELECT sum(freq) FROM base WHERE kind = b.kind) AS grp
          FROM base a, base b)
"""

_HKY_RATE = "(1.0 / (2 * 0.5 * 0.5 + 2 * 2.0 * (0.3 * 0.2 + 0.2 * 0.3)))::DOUBLE"

QUERIES = {
    "jc_matrix": Query(
        matrix(JukesCantor()),
        f"""{_GRID}
SELECT {sql_round("t", 2)} AS t, i, j,
       {sql_round("CASE WHEN i = j THEN 0.25 + 0.75 * exp(-4.0 * t / 3) ELSE 0.25 - 0.25 * exp(-4.0 * t / 3) END", 9)} AS p
FROM lengths, pairs"""),
    "gtr_matrix": Query(
        matrix(GTR),
        f"""WITH RECURSIVE {series_sql("SELECT DISTINCT round(l_discount, 2) AS t FROM lineitem")}
SELECT {sql_round("t", 2)} AS t, i, j, {sql_round("p", 9)} AS p FROM gtr"""),
    "hky_matrix": Query(
        matrix(HKY85(KAPPA, PI)),
        f"""{_GRID}
SELECT {sql_round("t", 2)} AS t, i, j,
       {sql_round(f'''CASE WHEN NOT same_kind THEN pj * (1 - exp(-{_HKY_RATE} * t))
         ELSE pj + pj * (1 / grp - 1) * exp(-{_HKY_RATE} * t)
              + ((CASE WHEN i = j THEN 1 ELSE 0 END) - pj / grp)
                * exp(-{_HKY_RATE} * t * (1 + grp * (2.0 - 1))) END''', 9)} AS p
FROM lengths, pairs"""),
}
