"""A balanced plan run layer by layer as joins: log(n) rounds for any tree shape.

Only components with some data at a pattern have a row. For the others the
value is known: a clade without data is all ones, and a segment without data
is the transition matrix of the path length it spans. Single inner edges
therefore never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import allows
from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.session import materialize, metric

_CELLS = [f"v{k}" for k in range(16)]
_LINK = ["parent", "side", "kind", "parent_layer", "left_span", "right_span",
         "left_clade", "right_clade"]


def _links(plan: DataFrame) -> DataFrame:
    """For every component: the merge it enters, on which side, and that merge's spans."""
    child = plan.select("tree_id", "comp_id", F.col("span").alias("s"), F.col("is_clade").alias("c"))
    merges = plan.filter("merge_type > 0").select(
        "tree_id", F.col("comp_id").alias("parent"), F.col("merge_type").alias("kind"),
        F.col("layer").alias("parent_layer"), "left", "right",
    )
    for side in ("left", "right"):
        merges = merges.join(
            child.select("tree_id", F.col("comp_id").alias(side), F.col("s").alias(f"{side}_span"),
                         F.col("c").alias(f"{side}_clade")), ["tree_id", side],
        )
    return merges.select(
        "tree_id", "parent", "kind", "parent_layer", "left_span", "right_span", "left_clade",
        "right_clade",
        F.explode(F.array(
            F.struct(F.col("left").alias("comp_id"), F.lit(True).alias("side")),
            F.struct(F.col("right").alias("comp_id"), F.lit(False).alias("side")),
        )).alias("e"),
    ).select("tree_id", "e.comp_id", "e.side", *[c for c in _LINK if c != "side"])


def layered_loglik(
    cells: DataFrame, plan: DataFrame, model: SubstitutionModel | None = None
) -> DataFrame:
    """(tree_id, pattern_id, loglik) of cells (pattern_id, taxon, symbol).

    ``plan`` is a balanced plan; leaf labels name the taxa. One grouped join
    per layer, and balanced plans have few layers.
    """
    model = model or JukesCantor()
    plan = materialize(plan, "plan", layers=F.max("layer"))
    links = materialize(_links(plan), "links")
    tips = plan.filter("merge_type = 0 and is_clade").select(
        "tree_id", "comp_id", F.col("label").alias("taxon"), "length"
    )
    state = [allows(F.col("symbol"), b) for b in "ACGT"]
    up = model.message(state, F.col("length"))
    empty = [F.lit(None).cast("double").alias(c) for c in _CELLS[4:]]
    values = cells.join(tips, "taxon").select(
        "tree_id", "comp_id", "pattern_id", F.lit(0.0).alias("scale"),
        *[u.alias(c) for u, c in zip(up, _CELLS)], *empty,
    )
    columns = ["tree_id", "pattern_id", "scale", *_CELLS, *_LINK]
    waiting = materialize(values.join(links, ["tree_id", "comp_id"]).select(*columns), "values")
    for layer in range(1, metric(plan, "layers") + 1):
        now = waiting.filter(F.col("parent_layer") == layer)
        merged = _merge(now, model)
        if layer == metric(plan, "layers"):
            tops = merged
            break
        later = waiting.filter(F.col("parent_layer") > layer)
        entered = merged.join(links, ["tree_id", "comp_id"], "left")
        waiting = materialize(later.unionByName(entered.select(*columns)).filter(
            "parent is not null"), "values")
        done = materialize(entered.filter("parent is null").select(
            "tree_id", "pattern_id", "scale", *_CELLS[:4]), "tops")
        finished = done if layer == 1 else finished.unionByName(done)
    tops = tops.select("tree_id", "pattern_id", "scale", *_CELLS[:4])
    if metric(plan, "layers") > 1:
        tops = tops.unionByName(finished)
    mean = sum((F.lit(p) * F.col(c) for p, c in zip(model.pi[1:], _CELLS[1:])),
               F.lit(model.pi[0]) * F.col("v0"))
    return tops.select("tree_id", "pattern_id", (F.ln(mean) + F.col("scale")).alias("loglik"))


def _merge(children: DataFrame, model: SubstitutionModel) -> DataFrame:
    """Both children of each merge side by side, absent ones by their known value."""
    keys = ["tree_id", F.col("parent").alias("comp_id"), "pattern_id", "kind", "left_span",
            "right_span", "left_clade", "right_clade"]
    side = F.col("side")
    pair = children.groupBy(*keys).agg(
        F.sum("scale").alias("scale"),
        *[F.max(F.when(side, F.col(c))).alias(f"l{k}") for k, c in enumerate(_CELLS)],
        *[F.max(F.when(~side, F.col(c))).alias(f"r{k}") for k, c in enumerate(_CELLS)],
    )
    kind = F.col("kind")

    def known(prefix: str, span: str, clade: str) -> list[Column]:
        blank = [
            F.when(F.col(clade), F.lit(1.0) if k < 4 else F.lit(None).cast("double"))
            .otherwise(model.probability(k // 4, k % 4, F.col(span)))
            for k in range(16)
        ]
        absent = F.col(f"{prefix}0").isNull()
        return [F.when(absent, b).otherwise(F.col(f"{prefix}{k}")).alias(f"{prefix}{k}")
                for k, b in enumerate(blank)]

    full = pair.select(
        "tree_id", "comp_id", "pattern_id", "kind", "scale",
        *known("l", "left_span", "left_clade"), *known("r", "right_span", "right_clade"),
    )
    le = [F.col(f"l{k}") for k in range(16)]
    ri = [F.col(f"r{k}") for k in range(16)]
    out = []
    for k in range(16):
        i, j = divmod(k, 4)
        wide = (
            F.when(kind == 2, le[i] * ri[k])
            .when(kind == 3, le[k] * ri[j])
            .when(kind == 5, sum((le[4 * i + m] * ri[4 * m + j] for m in (1, 2, 3)),
                                 le[4 * i] * ri[j]))
        )
        if k < 4:  # a clade's four values sit in the first four cells
            wide = (
                F.when(kind == 1, le[k] * ri[k])
                .when(kind == 4, sum((le[4 * k + m] * ri[m] for m in (1, 2, 3)),
                                     le[4 * k] * ri[0]))
                .otherwise(wide)
            )
        out.append(wide.alias(f"v{k}"))
    merged = full.select("tree_id", "comp_id", "pattern_id", "scale", *out)
    top = F.greatest(*[F.col(c) for c in _CELLS])
    return merged.withColumn("_top", top).select(
        "tree_id", "comp_id", "pattern_id",
        (F.col("scale") + F.when(F.col("_top") > 0, F.ln("_top")).otherwise(0.0)).alias("scale"),
        *[F.when(F.col("_top") > 0, F.col(c) / F.col("_top")).otherwise(F.col(c)).alias(c)
          for c in _CELLS],
    )
