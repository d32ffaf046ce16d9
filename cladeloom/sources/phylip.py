"""PHYLIP alignments read and written as DataFrames.

The text is a stream of blank-separated tokens: number of taxa, number of
sites, then name and sequence in turn, wherever the line breaks fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.codes import letters_from_symbols, symbols_from_letters
from cladeloom.operators.ranking import rank_in_group
from cladeloom.session import materialize


def read_phylip(spark: SparkSession, paths: str | list[str], per_file: bool = True) -> DataFrame:
    """(file, taxon_id, taxon, symbols, n_sites); taxon_id counts from 0 in file order.

    ``per_file=False`` reads all files, in name order, as the parts of one
    alignment. Rows beyond the declared number of taxa are ignored; missing
    rows, repeated names, wrong lengths and foreign letters fail.
    """
    file = F.col("_metadata.file_path")
    tokens = (
        spark.read.text(paths)
        .select(
            (file if per_file else F.lit("")).alias("file"),
            file.alias("_part"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
            F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias(
                "_k", "token"
            ),
        )
        .filter("token != ''")
    )
    # Places depend on how the scan was split, so they are read once and kept.
    tokens = materialize(tokens, "tokens")
    # Only the places are sorted; sequences join their number once.
    place = ["_part", "_start", "_line", "_k"]
    ranked = rank_in_group(
        tokens.select("file", *place), "file", [F.col(c) for c in place], "_n"
    )
    numbered = tokens.join(ranked, ["file", *place])
    heads = numbered.filter("_n < 2").groupBy("file").agg(
        F.max(F.when(F.col("_n") == 0, F.col("token"))).cast("bigint").alias("n_taxa"),
        F.max(F.when(F.col("_n") == 1, F.col("token"))).cast("bigint").alias("n_sites"),
    )
    even = F.col("_n") % 2 == 0
    pairs = (
        numbered.filter("_n >= 2")
        .withColumn("taxon_id", F.floor(F.col("_n") / 2).cast("bigint") - 1)
        .groupBy("file", "taxon_id")
        .agg(F.max(F.when(even, F.col("token"))).alias("taxon"),
             F.max(F.when(~even, F.col("token"))).alias("letters"))
    )
    rows = pairs.join(heads, "file").filter("taxon_id < n_taxa")
    found = rows.groupBy("file").agg(
        F.count("letters").alias("_rows"), F.countDistinct("taxon").alias("_names")
    )

    def check(bad, message, value):
        text = F.concat(F.lit(message), F.lit(" in "), F.col("file"))
        return F.when(bad, F.raise_error(text)).otherwise(value)

    checked = rows.join(found, "file").withColumn(
        "taxon",
        check(F.col("_rows") < F.col("n_taxa"), "fewer sequences than declared",
              check(F.col("_names") < F.col("_rows"), "repeated taxon name", F.col("taxon"))),
    )
    wrong = F.length("letters") != F.col("n_sites")
    alignment = checked.select(
        "file", "taxon_id", "taxon",
        check(wrong, "sequence of the wrong length",
              symbols_from_letters(F.col("letters"))).alias("symbols"),
        "n_sites",
    )
    # Written whole, so that no later choice of columns prunes a check away.
    return materialize(alignment, "alignment")


def align_to_taxa(alignment: DataFrame, taxa: DataFrame) -> DataFrame:
    """Renumber rows by a given (taxon_id, taxon); a name outside it fails."""
    known = taxa.select(F.col("taxon_id").alias("_id"), "taxon")
    message = F.concat(F.lit("sequence "), F.col("taxon"), F.lit(" is not a known taxon"))
    return alignment.join(known, "taxon", "left").withColumn(
        "taxon_id", F.when(F.col("_id").isNull(), F.raise_error(message)).otherwise(F.col("_id"))
    ).drop("_id")


def write_phylip(alignment: DataFrame, path: str) -> None:
    """Text parts that concatenate, in name order, to one PHYLIP file."""
    head = alignment.agg(
        F.count("*").alias("n"), F.max(F.length("symbols")).alias("w")
    ).select(
        F.lit(-1).cast("bigint").alias("taxon_id"),
        F.concat(F.col("n").cast("string"), F.lit("\t"), F.col("w").cast("string")).alias("value"),
    )
    body = alignment.select(
        "taxon_id",
        F.concat("taxon", F.lit(" "), letters_from_symbols(F.col("symbols"))).alias("value"),
    )
    (
        head.unionByName(body)
        .repartitionByRange("taxon_id").sortWithinPartitions("taxon_id")
        .select("value").write.text(path)
    )
