"""Trees scored as their files arrive, e.g. while a sampler is still writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeloom.functions.models import SubstitutionModel
from cladeloom.operators.likelihood import score_nodes
from cladeloom.session import materialize
from cladeloom.sources.newick import parse_newick


def score_arriving_trees(
    spark: SparkSession,
    folder: str,
    patterns: DataFrame,
    taxa: DataFrame,
    out: str,
    checkpoint: str,
    model: SubstitutionModel | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append (newick, loglik) of every new tree below ``folder`` to ``out``.

    Each micro-batch writes its own ``batch_id`` folder and overwrites it when
    repeated, so a restarted query neither loses nor doubles a tree.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        text = F.regexp_replace("value", r"\s+", "")
        trees = materialize(
            batch.select(text.alias("newick")).filter("newick != ''")
            .withColumn("tree_id", F.monotonically_increasing_id()), "arrived",
        )
        scores = score_nodes(patterns, parse_newick(trees), taxa, model)
        trees.join(scores, "tree_id").select("newick", "loglik").write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}"
        )

    lines = spark.readStream.format("text").option("lineSep", ";").load(folder)
    writer = lines.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
