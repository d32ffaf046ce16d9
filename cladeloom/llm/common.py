"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, y), chosen by a hash of the id.

    Rows without an id or a label are left out; of contradicting labels of one
    document the larger counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return (
        known.groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
