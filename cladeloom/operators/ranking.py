"""Global row numbers and neighbours without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.session import known_rows, materialize, metric

_OFFSET_BITS = 33  # monotonically_increasing_id(): partition above, row below


MAX_WINDOW_ROWS = 1_000_000  # what one task may sort; beyond it ranks span tasks


def global_rank(
    df: DataFrame, order: list[Column], name: str, max_window: int = MAX_WINDOW_ROWS
) -> DataFrame:
    """0-based BIGINT position of every row in the total order ``order``.

    Range partitioning sorts in parallel; the position is the row's offset in
    its partition plus the sizes of the partitions before it. Only those sizes
    (one row per partition) meet in one task. A table counted below
    ``max_window`` rows is numbered by one window instead. ``order`` must be
    unique.
    """
    df = materialize(df, name)
    if metric(df) <= max_window:
        return df.withColumn(
            name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")
        )
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_at", _OFFSET_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        placed.join(starts, "_part")
        .withColumn(name, (F.col("_start") + within).cast("bigint"))
        .drop("_part", "_at", "_start")
    )


def groups_are_small(df: DataFrame, group: str, max_window: int = MAX_WINDOW_ROWS) -> bool:
    """Whether every group may be sorted inside one task."""
    rows = known_rows(df)
    if rows is not None and rows <= max_window:
        return True
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    return largest is None or largest <= max_window


def rank_in_group(
    df: DataFrame, group: str, order: list[Column], name: str, small: bool = False
) -> DataFrame:
    """0-based position within each group.

    With ``small`` (see ``groups_are_small``) a window per group; otherwise a
    global rank minus the group's first, so that a hot group spans many tasks.
    """
    if small:
        w = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    ranked = global_rank(df, [F.col(group), *order], name)
    first = ranked.groupBy(group).agg(F.min(name).alias("_first"))
    return (
        ranked.join(first, group)
        .withColumn(name, F.col(name) - F.col("_first"))
        .drop("_first")
    )


def with_previous(
    df: DataFrame, rank: str, columns: list[str], prefix: str = "prev_", block: int = 65536
) -> DataFrame:
    """LAG over a dense rank, windowed per block of ranks.

    The last row of each block is also sent to the next block, so every row
    finds its predecessor locally and no window spans the whole table.
    """
    own = F.floor(F.col(rank) / block).cast("bigint")
    carry = F.when(F.col(rank) % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("_block").orderBy(rank)
    spread = df.withColumn("_block", F.explode(carry))
    for c in columns:
        spread = spread.withColumn(prefix + c, F.lag(c).over(w))
    return spread.filter(F.col("_block") == own).drop("_block")
