"""Balanced plans of trees too large for one task, wave by wave with joins.

The rule "each component, in order, merges with its lowest-numbered earlier
neighbour" picks, among the pairs that meet at a vertex, a greedy matching in
the order of (higher, lower) component number. A pair that comes first among
all pairs sharing one of its components belongs to that matching whatever
happens elsewhere, so all such pairs merge at once; pairs they touch drop out,
and the rest repeats. A merge never changes what other unmerged pairs of the
same wave may do, hence the result equals the one-by-one rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.operators.ranking import rank_in_group
from cladeloom.session import materialize, metric

_STATE = ["tree_id", "comp_id", "top", "bud", "layer", "span"]


def _edges(nodes: DataFrame) -> DataFrame:
    """Single-edge components: leaf edges first, then inner edges, in postorder."""
    below = materialize(nodes.filter("parent_id is not null"), "edges")
    leaves = below.groupBy("tree_id").agg(F.sum(F.col("is_leaf").cast("bigint")).alias("_n"))
    tips = rank_in_group(below.filter("is_leaf"), "tree_id", [F.col("post")], "_r")
    inner = rank_in_group(below.filter("not is_leaf"), "tree_id", [F.col("post")], "_r")
    both = tips.unionByName(inner).join(leaves, "tree_id")
    return materialize(
        both.select(
            "tree_id",
            F.when(F.col("is_leaf"), F.col("_r")).otherwise(F.col("_r") + F.col("_n")).alias("comp_id"),
            F.col("parent_id").alias("top"),
            F.when(~F.col("is_leaf"), F.col("node_id")).alias("bud"),
            F.lit(0).alias("layer"),
            F.when(~F.col("is_leaf"), F.col("length")).alias("span"),
            "node_id", "label", "length",
        ), "edges",
    )


def _pairs(active: DataFrame, counters: DataFrame) -> DataFrame:
    """Allowed merges whose higher component belongs to the current wave.

    At most three components meet at a vertex: one ending there and one or two
    hanging from it.
    """
    me = F.struct("comp_id", "top", "bud", "layer", "span")
    ends = active.select(
        "tree_id", F.explode(F.array(
            F.struct(F.col("top").alias("v"), F.lit(True).alias("hangs"), me.alias("c")),
            F.struct(F.col("bud").alias("v"), F.lit(False).alias("hangs"), me.alias("c")),
        )).alias("e"),
    ).select("tree_id", "e.v", "e.hangs", "e.c").filter("v is not null")
    hanging = F.when(F.col("hangs"), F.col("c"))
    at = ends.groupBy("tree_id", "v").agg(
        F.max(F.when(~F.col("hangs"), F.col("c"))).alias("a"),
        F.min(hanging).alias("lo"), F.max(hanging).alias("hi"),
        F.count(hanging).alias("n"),
    )
    a, lo, hi, two = F.col("a"), F.col("lo"), F.col("hi"), F.col("n") == 2

    def pair(left, right, kind, allowed):
        return F.when(
            allowed, F.struct(left.alias("l"), right.alias("r"), F.lit(kind).alias("kind"))
        )

    def clade(c):
        return c["bud"].isNull()

    both = a.isNotNull() & lo.isNotNull()
    options = F.array(
        pair(hi, lo, 1, two & clade(hi) & clade(lo)),
        pair(hi, lo, 2, two & clade(hi) & ~clade(lo)),
        pair(lo, hi, 2, two & clade(lo) & ~clade(hi)),
        pair(a, lo, 3, both & two & clade(lo)),
        pair(a, hi, 3, both & two & clade(hi)),
        pair(a, lo, 4, both & ~two & clade(lo)),
        pair(a, lo, 5, both & ~two & ~clade(lo)),
    )
    found = at.select("tree_id", F.explode(F.filter(options, lambda p: p.isNotNull())).alias("p"))
    left, right = F.col("p.l.comp_id"), F.col("p.r.comp_id")
    return found.join(counters, "tree_id").select(
        "tree_id", "p", F.greatest(left, right).alias("i"), F.least(left, right).alias("j"),
        "wave_start",
    ).filter("i >= wave_start").drop("wave_start")


def _greedy(pairs: DataFrame) -> DataFrame:
    """The matching picked by going through the pairs in order of (i, j)."""
    alive = materialize(pairs, "pairs")
    chosen = None
    while metric(alive):
        touch = alive.select("tree_id", "i", "j", F.explode(F.array("i", "j")).alias("c"))
        first = touch.groupBy("tree_id", "c").agg(F.min(F.struct("i", "j")).alias("f"))
        mine = F.struct("i", "j")
        best = alive
        for end in ("i", "j"):
            best = best.join(
                first.select("tree_id", F.col("c").alias(end), F.col("f").alias(f"_{end}")),
                ["tree_id", end],
            )
        won = materialize(
            best.filter((F.col("_i") == mine) & (F.col("_j") == mine)).drop("_i", "_j"), "won"
        )
        chosen = won if chosen is None else chosen.unionByName(won)
        used = won.select("tree_id", F.explode(F.array("i", "j")).alias("c"))
        for end in ("i", "j"):
            alive = alive.join(used.withColumnRenamed("c", end), ["tree_id", end], "left_anti")
        alive = materialize(alive, "pairs")
    return chosen


def plan_by_joins(nodes: DataFrame) -> DataFrame:
    """The balanced plan, row for row what the one-task planner makes."""
    from cladeloom.plans.decomposition import PLAN_SCHEMA, with_depths

    edges = _edges(nodes)
    active = edges.select(*_STATE)
    counters = materialize(
        edges.groupBy("tree_id").agg(
            F.lit(0).cast("bigint").alias("wave_start"), F.count("*").alias("next_id")
        ), "counters",
    )
    merges = []
    while True:
        chosen = _greedy(_pairs(active, counters))
        if chosen is None:
            break
        ranked = rank_in_group(chosen, "tree_id", [F.col("i")], "_r")
        p = F.col("p")
        made = materialize(
            ranked.join(counters, "tree_id").select(
                "tree_id",
                (F.col("next_id") + F.col("_r")).alias("comp_id"),
                p["l"]["comp_id"].alias("left"), p["r"]["comp_id"].alias("right"),
                p["kind"].alias("merge_type"),
                p["l"]["top"].alias("top"),
                F.when(p["kind"].isin(2, 5), p["r"]["bud"]).when(p["kind"] == 3, p["l"]["bud"])
                .alias("bud"),
                (1 + F.greatest(p["l"]["layer"], p["r"]["layer"])).alias("layer"),
                F.when(p["kind"] == 2, p["r"]["span"]).when(p["kind"] == 3, p["l"]["span"])
                .when(p["kind"] == 5, p["r"]["span"] + p["l"]["span"]).alias("span"),
            ), "made",
        )
        merges.append(made)
        used = made.select("tree_id", F.explode(F.array("left", "right")).alias("comp_id"))
        active = materialize(
            active.join(used, ["tree_id", "comp_id"], "left_anti").unionByName(made.select(*_STATE)),
            "active",
        )
        grown = made.groupBy("tree_id").agg(F.count("*").alias("_new"))
        counters = materialize(
            counters.join(grown, "tree_id").select(
                "tree_id", F.col("next_id").alias("wave_start"),
                (F.col("next_id") + F.col("_new")).alias("next_id"),
            ), "counters",
        )
    none = F.lit(None)
    plan = edges.select(
        "tree_id", "comp_id", none.cast("bigint").alias("left"), none.cast("bigint").alias("right"),
        F.lit(0).alias("merge_type"), "bud", "node_id", "label", "length", "layer", "span",
    )
    for made in merges:
        plan = plan.unionByName(made.select(
            "tree_id", "comp_id", "left", "right", "merge_type", "bud",
            none.cast("bigint").alias("node_id"), none.cast("string").alias("label"),
            none.cast("double").alias("length"), "layer", "span",
        ))
    plan = materialize(plan, "plan")
    up = plan.filter("merge_type > 0").select(
        "tree_id", F.col("comp_id").alias("parent"),
        F.explode(F.array("left", "right")).alias("comp_id"),
    )
    full = plan.join(up, ["tree_id", "comp_id"], "left").withColumn(
        "is_clade", F.col("bud").isNull()
    )
    columns = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
    return with_depths(full).select(*columns)
