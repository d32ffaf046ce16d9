"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cladeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Needed wherever the workers cannot import it themselves, that is, unless it
    is installed on every machine.
    """
    context = spark.sparkContext
    if getattr(context, "_cladeloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="cladeloom-zip-"), "cladeloom")
    archive = shutil.make_archive(
        base, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    context.addPyFile(archive)
    context._cladeloom_shipped = True


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    spark.conf.set(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="cladeloom-"))
    return spark.conf.get(CHECKPOINT_DIR)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", **metrics: Column) -> DataFrame:
    """``df`` written to the shared folder and read back, unless it already was.

    Cuts the lineage like a checkpoint, but computes the input once and keeps
    the columns prunable and the sizes known to the optimizer. The row count
    and any further ``metrics`` are observed during the write.
    """
    known = getattr(df, "_cladeloom_metrics", None)
    if known is not None:
        missing = [c.alias(k) for k, c in metrics.items() if k not in known]
        if missing:
            known.update(df.agg(*missing).first().asDict())
        return df
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]]
    df.observe(seen, *counts).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._cladeloom_metrics = dict(seen.get)
    stored._cladeloom_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more.

    Everything derived from them must have been written. Frames over which jobs are
    finished give up their shuffle files, too, once the driver collects them.
    """
    for table in tables:
        path = getattr(table, "_cladeloom_path", None)
        if path is None:
            continue
        jvm = table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        table._cladeloom_path = None
    gc.collect()
    for spark in {t.sparkSession for t in tables}:
        spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for work whose cost is compute, not bytes.

    A fixed partition count keeps adaptive execution from folding small but
    expensive inputs into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def sized_partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions of about ``bytes_each`` by the optimizer's estimate of the size of ``df``.

    At least the session's number, so small tables keep all cores busy.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = known_rows(df)
    if size >= 1 << 62 and rows is not None:  # an estimate the optimizer could not make
        size = rows * 128
    return max(least, min(1 << 17, -(-size // bytes_each)))


def metric(stored: DataFrame, name: str = "rows") -> int:
    """A number observed while ``materialize`` wrote the table."""
    return stored._cladeloom_metrics[name]


def known_rows(df: DataFrame) -> int | None:
    """Row count if ``df`` is a materialized table, else None."""
    found = getattr(df, "_cladeloom_metrics", None)
    return None if found is None else found["rows"]
