"""The five merges on long tables, one row per matrix or vector entry.

The readable twin of the block kernels: a clade is (pattern_id, i, value), a
segment is (pattern_id, i, j, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.plans import kernels as K


def merge_long(kind: int, left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.withColumnRenamed("value", "a"), right.withColumnRenamed("value", "b")
    product = (F.col("a") * F.col("b")).alias("value")
    if kind == K.CLADE_CLADE:
        return a.join(b, ["pattern_id", "i"]).select("pattern_id", "i", product)
    if kind == K.CLADE_SEGMENT:
        return a.join(b, ["pattern_id", "i"]).select("pattern_id", "i", "j", product)
    if kind == K.SEGMENT_SIDE_CLADE:
        b = b.withColumnRenamed("i", "j")
        return a.join(b, ["pattern_id", "j"]).select("pattern_id", "i", "j", product)
    if kind == K.SEGMENT_END_CLADE:
        b = b.withColumnRenamed("i", "j")
        joined = a.join(b, ["pattern_id", "j"]).select("pattern_id", "i", product)
        return joined.groupBy("pattern_id", "i").agg(F.sum("value").alias("value"))
    if kind == K.SEGMENT_SEGMENT:
        a = a.withColumnRenamed("j", "k")
        b = b.withColumnRenamed("i", "k")
        joined = a.join(b, ["pattern_id", "k"]).select("pattern_id", "i", "j", product)
        return joined.groupBy("pattern_id", "i", "j").agg(F.sum("value").alias("value"))
    raise ValueError(f"merge type {kind}")
