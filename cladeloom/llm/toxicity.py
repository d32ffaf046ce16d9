"""Toxicity by cumulative-link ordinal regression.

Words of labelled documents are sparse features. One weight vector serves all
grades; ordered thresholds cut the score into four grades, and the expected
severity is the sum over grades g >= 1 of P(grade >= g). Grades of the labels:
0 is not toxic; toxic documents are graded 1 to 3 by the terciles of how many
marked words they hold, a marked word being one that occurs nearly only in toxic
documents.

Fitting takes a bounded sample of labelled rows (``MAX_ROWS``, by a hash of the
id). Features are all words in at least ``MIN_DOCS`` of them whose share of toxic
documents is ``MIN_Z`` standard deviations or more away from that of all (if no word
is, those farthest away); scoring reads every whole text.

Defined results: a null text is an empty one and gets the severity of a document
without known words; without any toxic label nothing is known and every severity
is 0; repeated rows are scored each for itself, and of rows with one id only that of
the least text is fitted; columns besides ``doc_id`` and
``text`` are kept as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import bounded_labels, text_or_empty
from cladeloom.session import materialize, metric

MAX_ROWS = 20_000
MIN_Z = 2.0
MIN_DOCS = 5
GRADES = 4
REJECT_AT = 0.5
WORDS = 1 << 16  # rows of words sent at once

_WORD = re.compile(r"\w+")
SCHEMA = "struct<severity: double, p_toxic: double, grade: int>"


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def severity(self, text: str) -> tuple[float, float, int]:
        """Expected severity, P(toxic) and the likeliest grade."""
        if not self.thresholds:
            return 0.0, 0.0, 0
        counts = word_counts(text)
        known = self.weights.keys() & counts.keys()
        score = sum(self.weights[w] * np.log1p(counts[w]) for w in sorted(known))
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score, -500, 500)))
        each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), float(above[0]), int(each.argmax())


def _sample_words(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, word, n) of the sampled documents, one row of each id."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, words, ns = [], [], [], []
            for doc_id, text, y in zip(*batch.columns):
                counts = word_counts(text.as_py())
                ids += [doc_id.as_py()] * len(counts)
                ys += [y.as_py()] * len(counts)
                words += counts.keys()
                ns += counts.values()
                if len(ids) > WORDS:
                    yield listed(ids, ys, words, ns)
                    ids, ys, words, ns = [], [], [], []
            yield listed(ids, ys, words, ns)

    def listed(ids: list, ys: list, words: list, ns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())],
            names=["doc_id", "y", "word", "n"])

    typed = rows.select(F.col("doc_id").cast("bigint"), "text", "y")
    return typed.mapInArrow(run, "doc_id bigint, y int, word string, n bigint")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_z: float = MIN_Z) -> OrdinalModel:
    sample = materialize(bounded_labels(labels, "toxic", max_rows), "toxic_sample")
    said = materialize(_sample_words(docs, sample), "toxic_words")
    totals = sample.agg(F.count("*").alias("n"), F.sum("y").alias("bad")).first()
    if not totals["n"] or not totals["bad"] or totals["bad"] == totals["n"]:
        return OrdinalModel()
    base = totals["bad"] / totals["n"]
    stats = said.groupBy("word").agg(F.count("*").alias("docs"), F.sum("y").alias("bad"))
    spread = F.sqrt(F.col("docs") * base * (1 - base))
    known = materialize(
        stats.filter(F.col("docs") >= min(MIN_DOCS, totals["bad"]))
        .withColumn("z", F.abs(F.col("bad") - F.col("docs") * base) / spread),
        "toxic_stats", farthest=F.max("z"),
    )
    least = min(min_z, metric(known, "farthest") or 0.0)
    vocabulary = known.filter(F.col("z") >= least).orderBy(F.col("z").desc(), "word").collect()
    place = {r["word"]: k for k, r in enumerate(vocabulary)}
    if not place:
        return OrdinalModel()
    marked = np.array([r["bad"] >= 0.8 * r["docs"] for r in vocabulary])
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(place.items()), "word string, k int")
    rows = (
        said.join(F.broadcast(chosen), "word")
        .groupBy("doc_id")
        .agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n"))
        .join(sample, "doc_id", "right")
        .orderBy("doc_id")
        .collect()
    )
    y = np.array([r["y"] for r in rows])
    at = np.concatenate([np.full(len(r["k"] or ()), i) for i, r in enumerate(rows)]).astype(int)
    k = np.concatenate([r["k"] or [] for r in rows]).astype(int)
    n = np.concatenate([r["n"] or [] for r in rows]).astype(float)
    grades = _grades(y, np.bincount(at, weights=n * marked[k], minlength=len(y)))
    w, cuts = _fit(at, k, np.log1p(n), grades, len(place))
    words = list(place)
    return OrdinalModel({words[j]: float(w[j]) for j in np.flatnonzero(np.abs(w) > 1e-4)}, cuts.tolist())


def _grades(y: np.ndarray, hits: np.ndarray) -> np.ndarray:
    toxic = y > 0
    low, high = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (hits > low) + (hits > high), 0)


def slope(params, at, k, x, grades, width, ridge):
    """Gradient of the penalised negative log-likelihood a document.

    ``params``: weights, the first cut, logarithms of the gaps between cuts.
    """
    n = len(grades)
    w, gaps = params[:width], np.exp(params[width + 1:])
    cuts = params[width] + np.concatenate([[0.0], np.cumsum(gaps)])
    score = np.bincount(at, weights=w[k] * x, minlength=n)
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(over="ignore"):
        upper = 1 / (1 + np.exp(score - edges[grades + 1]))
        lower = 1 / (1 + np.exp(score - edges[grades]))
    inside = np.maximum(upper - lower, 1e-12)
    by_score = 1 - upper - lower
    up, down = upper * (1 - upper) / inside, lower * (1 - lower) / inside
    by_cut = np.bincount(grades, weights=-up, minlength=GRADES)[:-1]
    by_cut = by_cut + np.bincount(grades, weights=down, minlength=GRADES)[1:]
    tail = np.cumsum(by_cut[::-1])[::-1]
    return np.concatenate([
        np.bincount(k, weights=by_score[at] * x, minlength=width) / n + ridge * w,
        [tail[0] / n], tail[1:] * gaps / n,
    ])


def _fit(at, k, x, grades, width, steps: int = 400, rate: float = 0.05, ridge: float = 2e-4, still: float = 1e-6):
    """Weights and increasing thresholds that maximise the penalised likelihood (Adam).

    Ends after ``steps``, or before once no part of the gradient passes ``still``.
    """
    params = np.concatenate([np.zeros(width), [2.0], np.zeros(GRADES - 2)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        gradient = slope(params, at, k, x, grades, width, ridge)
        if np.abs(gradient).max() < still:
            break
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params = params - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[width + 1:])
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def severity(model: OrdinalModel, text: str = "text") -> Column:
    """struct(severity, p_toxic, grade) of a text column."""

    @F.pandas_udf(SCHEMA)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.severity(t) for t in texts], columns=["severity", "p_toxic", "grade"])

    return score(text_or_empty(text))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic, one row per row of ``docs``."""
    found = docs.select("doc_id", severity(model).alias("_s"))
    return found.select("doc_id", "_s.severity", "_s.p_toxic", "_s.grade",
                        (F.col("_s.p_toxic") >= REJECT_AT).alias("toxic"))


def reject(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    return docs.filter(severity(model)["p_toxic"] < REJECT_AT)
