"""Tab-separated result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header)
