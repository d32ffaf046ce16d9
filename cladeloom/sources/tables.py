"""Alignments and trees that Spark derives from ordinary relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeloom.functions.codes import symbol_of_code
from cladeloom.operators.blocks import placed
from cladeloom.session import spread

MAX_PIVOT_TAXA = 512  # above this the aggregate row would outgrow code generation


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxa_of(df: DataFrame, taxon: Column) -> list:
    """Distinct taxon keys in order, refused beyond the pivot bound."""
    rows = (
        df.select(taxon.alias("t")).distinct().orderBy("t").limit(MAX_PIVOT_TAXA + 1).collect()
    )
    if len(rows) > MAX_PIVOT_TAXA:
        raise ValueError("too many taxa for pivoted sites; use site_cells with the long form")
    return [r.t for r in rows]


def base_code(value: Column) -> Column:
    """State code 0-3 of a non-negative measure."""
    return F.floor(value).cast("bigint") % 4


def pivoted_sites(
    df: DataFrame, site: dict[str, Column], taxon: Column, value: Column, taxa: list
) -> DataFrame:
    """One row per site with its pattern string; one shuffle, partial max before it."""
    keyed = df.select(*[c.alias(k) for k, c in site.items()], taxon.alias("_t"), value.alias("_v"))
    cells = keyed.groupBy(*site).agg(
        *[F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(f"_c{k}") for k, t in enumerate(taxa)]
    )
    symbols = [symbol_of_code(base_code(F.col(f"_c{k}"))) for k in range(len(taxa))]
    return cells.select(*site, F.concat(*symbols).alias("pattern"))


def site_cells(
    df: DataFrame, site: dict[str, Column], taxon: Column, value: Column
) -> DataFrame:
    """Present cells only: site columns, ``taxon`` and ``symbol``."""
    keyed = df.select(
        *[c.alias(k) for k, c in site.items()], taxon.alias("taxon"), value.alias("_v")
    )
    return (
        keyed.groupBy(*site, "taxon")
        .agg(F.max("_v").alias("_v"))
        .select(*site, "taxon", symbol_of_code(base_code(F.col("_v"))).alias("symbol"))
    )


# --- alignments -------------------------------------------------------------


def event_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxa are event types, sites are (user, day)."""
    ev = read_table(spark, sf_dir, "events")
    taxa = taxa_of(ev, F.col("event_type"))
    site = {"user_id": F.col("user_id"), "day": F.to_date("ts")}
    return pivoted_sites(ev, site, F.col("event_type"), F.col("value"), taxa)


def lineitem_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxa are line numbers, sites are orders."""
    li = read_table(spark, sf_dir, "lineitem")
    taxa = taxa_of(li, F.col("l_linenumber"))
    site = {"l_orderkey": F.col("l_orderkey")}
    return pivoted_sites(li, site, F.col("l_linenumber"), F.col("l_quantity"), taxa)


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxa are suppliers, sites are ship months; long form, taxa grow with the data."""
    li = read_table(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return site_cells(
        li, {"site": month.cast("bigint")}, F.col("l_suppkey"), F.col("l_extendedprice")
    )


# --- trees ------------------------------------------------------------------
# Node ids of the foreign-key trees carry the level in the high digits.
LEVEL = 1_000_000_000_000


def key_length(key: Column) -> Column:
    return (1 + key % 7).cast("double") / 100


def supplier_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root - region - nation - supplier; nodes without a supplier are left out."""
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    nation = nation.join(
        supplier.select("s_nationkey").distinct(), nation.n_nationkey == F.col("s_nationkey"),
        "left_semi",
    )
    region = region.join(
        nation.select("n_regionkey").distinct(), region.r_regionkey == F.col("n_regionkey"),
        "left_semi",
    )

    def node(df, node_id, parent, order, label, length, leaf):
        return df.select(
            F.lit(0).cast("bigint").alias("tree_id"),
            node_id.cast("bigint").alias("node_id"),
            parent.cast("bigint").alias("parent_id"),
            order.cast("bigint").alias("child_ord"),
            label.alias("label"),
            length.cast("double").alias("length"),
            F.lit(leaf).alias("is_leaf"),
        )

    rk, nk, sk = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    root = node(
        region.agg(F.min("r_regionkey").alias("k")).filter("k is not null"),
        F.lit(0), F.lit(None), F.lit(0), F.lit("root"), F.lit(0.0), False,
    )
    return (
        root.unionByName(
            node(region, LEVEL + rk, F.lit(0), rk, F.col("r_name"), key_length(rk), False)
        )
        .unionByName(
            node(nation, 2 * LEVEL + nk, LEVEL + F.col("n_regionkey"), nk, F.col("n_name"),
                 key_length(nk), False)
        )
        .unionByName(
            node(supplier, 3 * LEVEL + sk, 2 * LEVEL + F.col("s_nationkey"), sk, F.col("s_name"),
                 key_length(sk), True)
        )
    )


def customer_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per customer: customer - order - line; only orders that have lines."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = spread(  # told apart where they meet their order
        read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"
    ).distinct()
    leaf = spread(
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_custkey", "o_orderkey", "l_linenumber"), "o_custkey",
    )
    ok, ln, level = F.col("o_orderkey"), F.col("l_linenumber"), F.col("_level")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber"))
    # The first line of a customer or an order also gives the rows above it.
    top = F.when(before.isNull(), 0).when(before != ok, 1).otherwise(2)
    rows = leaf.withColumn("_top", top).withColumn("_level", F.explode(F.sequence("_top", F.lit(2))))

    def by_level(root, inner, tip):
        return F.when(level == 0, root).when(level == 1, inner).otherwise(tip)

    return placed(rows.select(
        F.col("o_custkey").alias("tree_id"),
        by_level(F.lit(-1).cast("bigint"), ok * 8, ok * 8 + ln).alias("node_id"),
        by_level(F.lit(None).cast("bigint"), F.lit(-1).cast("bigint"), ok * 8).alias("parent_id"),
        by_level(F.lit(0).cast("bigint"), ok, ln.cast("bigint")).alias("child_ord"),
        by_level(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("O"), ok.cast("string")),
            F.concat(F.lit("L"), ok.cast("string"), F.lit("_"), ln.cast("string")),
        ).alias("label"),
        by_level(F.lit(0.0), key_length(ok), (1 + (ok + ln) % 5).cast("double") / 100).alias("length"),
        (level == 2).alias("is_leaf"),
    ))
