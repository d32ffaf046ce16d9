"""Likelihood with every distinct sub-pattern computed once in the whole job.

What a component of a plan gives for a pattern depends only on the symbols of its
own taxa, its sub-pattern. A dictionary holds the distinct sub-patterns of every
component over all partitions: batches list theirs, grouped by key. Going up the
layers of the plan, the value of a sub-pattern is merged from those of its two
parts, which are joined by their keys; patterns meet their value only at the root.
Balanced plans have about log(n) layers.

Keys are the symbols themselves or, of more than ``KEY_SYMBOLS`` taxa, a digest of
128 bits. Components without taxa of their own have the empty key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.codes import SYMBOLS, codes_of_strings, state_matrix
from cladeloom.functions.models import JukesCantor, SubstitutionModel
from cladeloom.operators.likelihood import MAX_BROADCAST_COMPONENTS, TreePlan, load_plans, plan_with_taxa
from cladeloom.plans import kernels
from cladeloom.session import materialize, metric

KEY_SYMBOLS = 24
_SYMBOLS = np.frombuffer(SYMBOLS.encode(), np.uint8)
_NODE = "tree_id bigint, comp_id bigint, key binary"
_ENTRY = _NODE + ", left bigint, right bigint, left_key binary, right_key binary, merge_type int, layer int"
_VALUE = _NODE + ", value array<double>, scale bigint"


def key_of(symbols: bytes) -> bytes:
    return symbols if len(symbols) <= KEY_SYMBOLS else blake2b(symbols, digest_size=16).digest()


class _Reader:
    """The sub-patterns of one plan in a batch of patterns."""

    def __init__(self, plan: TreePlan):
        self.plan = plan
        self.taxa: dict[int, np.ndarray] = {}
        self.layer: dict[int, int] = {}
        for c in [*np.flatnonzero(plan.kind == 0).tolist(), *plan.order]:
            if plan.kind[c]:
                left, right = int(plan.left[c]), int(plan.right[c])
                self.taxa[c] = np.concatenate([self.taxa[left], self.taxa[right]])
                self.layer[c] = 1 + max(self.layer[left], self.layer[right])
            else:
                self.taxa[c] = plan.taxon[[c]] if plan.taxon[c] >= 0 else np.empty(0, np.int64)
                self.layer[c] = 0

    def entries(self, codes: np.ndarray) -> Iterator[tuple]:
        """(comp_id, key, left, right, left_key, right_key, merge_type, layer) of (taxa, patterns) codes."""
        plan, alike = self.plan, np.zeros(codes.shape[1], np.int64)
        ids = {c: codes[plan.taxon[c]].astype(np.int64) if plan.taxon[c] >= 0 else alike
               for c in np.flatnonzero(plan.kind == 0).tolist()}
        for c in plan.order:
            left, right = int(plan.left[c]), int(plan.right[c])
            a, b = ids.pop(left), ids.pop(right)
            _, first, ids[c] = np.unique(a * (b.max() + 1) + b, return_index=True, return_inverse=True)
            for k in first.tolist():
                keys = [key_of(_SYMBOLS[codes[self.taxa[x], k]].tobytes()) for x in (c, left, right)]
                yield c, keys[0], left, right, keys[1], keys[2], int(plan.kind[c]), self.layer[c]


def dictionary(patterns: DataFrame, plan: DataFrame, model: SubstitutionModel | None = None) -> DataFrame:
    """Distinct sub-patterns of every merged component, with the keys of their parts.

    (tree_id, comp_id, key, left, right, left_key, right_key, merge_type, layer); ``plan``
    has ``taxon_id``. A batch sends each of its sub-patterns once.
    """
    plan = materialize(plan, "plan")
    if metric(plan) > MAX_BROADCAST_COMPONENTS:
        raise ValueError("plans of this size travel to no batch; use pattern_loglik, which joins them")
    shared = patterns.sparkSession.sparkContext.broadcast(load_plans(plan, model or JukesCantor()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {t: _Reader(p) for t, p in shared.value.items()}
        names = [part.split()[0] for part in _ENTRY.split(", ")]
        for pdf in batches:
            codes = np.ascontiguousarray(codes_of_strings(pdf["pattern"].tolist()).T)
            for tree_id, reader in readers.items():
                rows = [(tree_id, *entry) for entry in reader.entries(codes)] if codes.size else []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    listed = patterns.select("pattern").mapInPandas(run, _ENTRY)
    rest = ["left", "right", "left_key", "right_key", "merge_type", "layer"]
    return listed.groupBy("tree_id", "comp_id", "key").agg(*[F.first(c).alias(c) for c in rest])


def component_taxa(plan: DataFrame) -> DataFrame:
    """(tree_id, comp_id, taxa) of a materialized plan with ``taxon_id``: the positions below each component, ascending."""
    none = F.array().cast("array<bigint>")
    own = F.when(F.col("taxon_id").isNotNull(), F.array("taxon_id")).otherwise(none)
    known = plan.filter("merge_type = 0").select("tree_id", "comp_id", own.alias("taxa"))
    layers = plan.agg(F.max("layer")).first()[0] or 0
    for layer in range(1, layers + 1):
        side = lambda e: known.select("tree_id", F.col("comp_id").alias(e), F.col("taxa").alias(e + "_taxa"))  # noqa: B023, E731
        above = plan.filter(F.col("layer") == layer).select("tree_id", "comp_id", "left", "right")
        both = above.join(side("left"), ["tree_id", "left"]).join(side("right"), ["tree_id", "right"])
        joined = both.select("tree_id", "comp_id", F.sort_array(F.concat("left_taxa", "right_taxa")).alias("taxa"))
        known = materialize(known.unionByName(joined), "component_taxa")
    return known


def _edge_values(plan: DataFrame, model: SubstitutionModel) -> DataFrame:
    """Values of single edges: per symbol for leaf edges, one matrix for inner ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            matrices = model.matrices(pdf["length"].fillna(0.0).to_numpy(float)) if len(pdf) else []
            for tree, comp, taxon, matrix in zip(pdf["tree_id"], pdf["comp_id"], pdf["taxon_id"], matrices):
                if pd.isna(taxon):
                    rows.append((tree, comp, b"", matrix.ravel().tolist(), 0))
                    continue
                table = kernels.leaf_table(matrix, state_matrix())
                rows += [(tree, comp, SYMBOLS[s].encode(), table[:, s].tolist(), 0) for s in range(table.shape[1])]
            yield pd.DataFrame(rows, columns=["tree_id", "comp_id", "key", "value", "scale"])

    edges = plan.filter("merge_type = 0 AND parent IS NOT NULL").select("tree_id", "comp_id", "taxon_id", "length")
    return edges.mapInPandas(run, _VALUE)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of joined rows (tree_id, comp_id, key, merge_type, a, a_scale, b, b_scale), kind by kind."""
    for batch in batches:
        kind = batch.column("merge_type").to_numpy()
        for how in np.unique(kind).tolist():
            rows = batch.filter(pa.array(kind == how))

            def block(name: str) -> np.ndarray:
                column = rows.column(name)
                flat = column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                return np.ascontiguousarray(flat.T).reshape((4, -1) if flat.shape[1] == 4 else (4, 4, -1))

            scale = rows.column("a_scale").to_numpy() + rows.column("b_scale").to_numpy()
            value, scale = kernels.rescale(kernels.merge(how, block("a"), block("b")), scale)
            flat = np.ascontiguousarray(value.reshape(-1, rows.num_rows).T)
            ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("tree_id", "comp_id", "key")), pa.ListArray.from_arrays(ends, flat.ravel()),
                 pa.array(np.asarray(scale, np.int64))], names=["tree_id", "comp_id", "key", "value", "scale"])


def values(entries: DataFrame, plan: DataFrame, model: SubstitutionModel) -> DataFrame:
    """(tree_id, comp_id, key, value, scale) of all sub-patterns in ``entries`` (materialized), layer by layer."""
    known = [materialize(_edge_values(plan, model), "edge_values")]
    layers = metric(materialize(entries, "entries", layers=F.max("layer")), "layers") or 0
    for layer in range(1, layers + 1):
        below = reduce(DataFrame.unionByName, known)
        side = lambda e, n: below.select("tree_id", F.col("comp_id").alias(e), F.col("key").alias(e + "_key"),  # noqa: B023, E731
                                         F.col("value").alias(n), F.col("scale").alias(n + "_scale"))
        joined = (
            entries.filter(F.col("layer") == layer)
            .join(side("left", "a"), ["tree_id", "left", "left_key"])
            .join(side("right", "b"), ["tree_id", "right", "right_key"])
        )
        given = joined.select("tree_id", "comp_id", "key", "merge_type", "a", "a_scale", "b", "b_scale")
        known.append(materialize(given.mapInArrow(_merged, _VALUE), "layer_values"))
    return reduce(DataFrame.unionByName, known[1:], known[0].limit(0))


def consed_loglik(
    patterns: DataFrame, plan: DataFrame, taxa: DataFrame, model: SubstitutionModel | None = None
) -> tuple[DataFrame, DataFrame]:
    """(tree_id, pattern_id, freq, loglik), and the dictionary with one row per merged column."""
    model = model or JukesCantor()
    plan = materialize(plan_with_taxa(plan, taxa), "plan")
    entries = materialize(dictionary(patterns, plan, model), "entries", layers=F.max("layer"))
    root = plan.filter("parent IS NULL").select("tree_id", "comp_id")
    found = values(entries, plan, model).join(root, ["tree_id", "comp_id"]).select("tree_id", "key", "value", "scale")
    pi = [float(p) for p in model.pi]
    likelihood = reduce(lambda a, b: a + b, [F.get("value", F.lit(k)) * p for k, p in enumerate(pi)])
    scored = found.select("tree_id", "key", (F.log(likelihood) + F.col("scale") * float(np.log(2.0))).alias("loglik"))
    return _with_root_key(patterns, plan).join(scored, ["tree_id", "key"]).select(
        "tree_id", "pattern_id", "freq", "loglik"), entries


def _with_root_key(patterns: DataFrame, plan: DataFrame) -> DataFrame:
    """Patterns with the key of the root of every tree: their symbols in the order of its merges."""
    shared = patterns.sparkSession.sparkContext.broadcast(load_plans(plan, JukesCantor()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {t: _Reader(p) for t, p in shared.value.items()}
        for pdf in batches:
            codes = codes_of_strings(pdf["pattern"].tolist())
            for tree_id, reader in readers.items():
                symbols = _SYMBOLS[codes[:, reader.taxa[reader.plan.order[-1]]]] if len(pdf) else []
                yield pd.DataFrame({"tree_id": tree_id, "key": [key_of(s.tobytes()) for s in symbols],
                                    "pattern_id": pdf["pattern_id"], "freq": pdf["freq"]})

    return patterns.select("pattern_id", "pattern", "freq").mapInPandas(
        run, "tree_id bigint, key binary, pattern_id bigint, freq bigint")
