"""Site patterns: transpose, compress, order, difference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import SYMBOLS
from cladeloom.operators.ranking import global_rank, with_previous

BLOCK_CELLS = 4_000_000  # taxa x sites in one transposed block


def transpose(
    alignment: DataFrame, n_taxa: int | None = None, n_sites: int | None = None
) -> DataFrame:
    """Rows (taxon_id, symbols) to columns (site, pattern), duplicates kept.

    Rows are cut into site blocks, so a task holds one block of bounded size
    and the shuffle moves whole slices instead of single cells. Sizes not given
    are counted; a row of another length than ``n_sites`` fails.
    """
    if n_taxa is None or n_sites is None:
        size = alignment.agg(
            F.count("*").alias("taxa"), F.max(F.length("symbols")).alias("sites")
        ).first()
        n_taxa, n_sites = n_taxa or size.taxa, n_sites or size.sites
    width = max(1, min(n_sites, BLOCK_CELLS // max(1, n_taxa)))
    last_block = (n_sites - 1) // width
    slices = (
        alignment.select(
            "taxon_id",
            F.when(F.length("symbols") == n_sites, F.col("symbols"))
            .otherwise(F.raise_error(F.lit(f"a sequence does not have {n_sites} sites")))
            .alias("symbols"),
        )
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last_block))))
        .withColumn("octets", F.col("symbols").cast("binary"))  # cut at an offset, not by walking
        .withColumn(
            "slice", F.substring("octets", F.col("block") * width + 1, F.lit(width)).cast("string")
        )
        .select("block", "taxon_id", "slice")
    )

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("taxon_id")["slice"]
        grid = np.frombuffer("".join(rows).encode(), np.uint8).reshape(len(rows), -1)
        columns = np.ascontiguousarray(grid.T).tobytes().decode()
        step = len(rows)
        site0 = int(pdf["block"].iloc[0]) * width
        return pd.DataFrame(
            {
                "site": np.arange(site0, site0 + grid.shape[1], dtype=np.int64),
                "pattern": [columns[k : k + step] for k in range(0, len(columns), step)],
            }
        )

    return slices.groupBy("block").applyInPandas(turn, "site bigint, pattern string")


def uncompressed(sites: DataFrame) -> DataFrame:
    """Every site as its own pattern with frequency 1."""
    return sites.withColumn("freq", F.lit(1).cast("bigint"))


def compress(sites: DataFrame) -> DataFrame:
    """Distinct patterns with their number of sites; counts combine before the shuffle."""
    return sites.groupBy("pattern").agg(F.count("*").alias("freq"))


def zigzag_key(pattern: Column) -> Column:
    """Sort key under which every second taxon runs in reverse state order."""
    mirrored = SYMBOLS[::-1]
    return F.array_join(
        F.transform(
            F.split(pattern, ""),
            lambda s, i: F.when(i % 2 == 1, F.translate(s, SYMBOLS, mirrored)).otherwise(s),
        ),
        "",
    )


def order_patterns(patterns: DataFrame, method: str = "lex") -> DataFrame:
    """Number patterns from 0: ``uncompressed``/``lex``, ``zigzag`` or ``tour`` order."""
    if method == "zigzag":
        return global_rank(patterns, [zigzag_key(F.col("pattern"))], "pattern_id")
    if method == "lex":
        return global_rank(patterns, [F.col("pattern")], "pattern_id")
    if method == "tour":
        from cladeloom.operators.tour import tour_order

        return tour_order(patterns)
    raise ValueError(f"unknown pattern order {method!r}")


def compress_patterns(sites: DataFrame, method: str = "lex") -> DataFrame:
    """(pattern_id, pattern, freq) of an alignment given as sites."""
    if method == "uncompressed":
        keys = [F.col(c) for c in sites.columns if c != "pattern"]
        return global_rank(uncompressed(sites), keys, "pattern_id")
    return order_patterns(compress(sites), method)


def hamming(a: Column, b: Column) -> Column:
    """Number of positions at which two equal-length strings differ."""
    marks = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("bigint"))
    return F.aggregate(marks, F.lit(0).cast("bigint"), lambda s, x: s + x)


def pattern_diffs(ordered: DataFrame) -> DataFrame:
    """(pattern_id, taxon_id, symbol) changed since the previous pattern.

    The first pattern lists all its taxa.
    """
    paired = with_previous(ordered.select("pattern_id", "pattern"), "pattern_id", ["pattern"])
    now = F.split("pattern", "")
    before = F.coalesce(
        F.split("prev_pattern", ""), F.array_repeat(F.lit(""), F.length("pattern"))
    )
    cells = paired.select(
        "pattern_id",
        F.explode(
            F.filter(
                F.zip_with(
                    F.arrays_zip(
                        now.alias("symbol"),
                        F.sequence(F.lit(0), F.length("pattern") - 1).alias("taxon_id"),
                    ),
                    before,
                    lambda x, y: F.when(
                        x["symbol"] != y,
                        F.struct(x["taxon_id"].alias("taxon_id"), x["symbol"].alias("symbol")),
                    ),
                ),
                lambda c: c.isNotNull(),
            )
        ).alias("c"),
    )
    return cells.select(
        "pattern_id", F.col("c.taxon_id").cast("bigint").alias("taxon_id"), "c.symbol"
    )


def path_length(ordered: DataFrame) -> DataFrame:
    """Total and average distance between neighbours of an ordering, one row.

    Averages divide by the number of sites minus one and of patterns minus one.
    """
    paired = with_previous(
        ordered.select("pattern_id", "pattern", "freq"), "pattern_id", ["pattern"]
    )
    step = F.when(
        F.col("prev_pattern").isNotNull(), hamming(F.col("pattern"), F.col("prev_pattern"))
    ).otherwise(0)
    totals = paired.agg(
        F.sum("freq").alias("n_sites"),
        F.count("*").alias("n_patterns"),
        F.sum(step).cast("bigint").alias("path_length"),
    )
    return totals.select(
        "n_sites",
        "n_patterns",
        "path_length",
        (F.col("path_length") / (F.col("n_sites") - 1)).alias("avg_site_distance"),
        (F.col("path_length") / (F.col("n_patterns") - 1)).alias("avg_pattern_distance"),
    )
