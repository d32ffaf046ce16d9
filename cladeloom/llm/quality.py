"""Quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. Small boosted trees are grown over them;
every path from a root to a node becomes a conjunctive rule, a lasso logistic
regression keeps few rules, and the kept rules are compiled into one column
expression. No label, language, source or id is a feature.

Fitting takes a bounded sample of labelled rows (``MAX_ROWS``, by a hash of the
id); scoring reads every whole text.

Defined results: a null text is an empty one and is scored as such; without
labels of both kinds every score is the share of good labels, or 0.5; repeated
rows are scored each for itself, and of rows with one id only that of the least
statistics is fitted; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import SPACES, bounded_labels, text_or_empty

MAX_ROWS = 20_000
TREES = 40
DEPTH = 3
LASSO = 1.5e-3


def statistics() -> dict[str, Column]:
    """Name and column of each statistic, over columns added by ``with_statistics``."""
    chars, words, lines = F.col("_chars"), F.size("_words"), F.size("_lines")
    share = lambda kept: (chars - F.length(kept)) / chars
    without = lambda pattern: share(F.regexp_replace("_text", pattern, ""))
    return {
        "chars": chars.cast("double"),
        "words": words.cast("double"),
        "chars_per_word": chars / words,
        "upper": without("[A-Z\\u00C0-\\u00DE]+"),
        "digits": without("[0-9]+"),
        "signs": without("[#$%&*@^~=<>{}\\[\\]\\\\/+_-]+"),
        "bars": share(F.replace("_text", F.lit("|"), F.lit(""))),
        "bangs": share(F.replace("_text", F.lit("!"), F.lit(""))),
        "stops": share(F.replace("_text", F.lit("."), F.lit(""))),
        "commas": share(F.replace("_text", F.lit(","), F.lit(""))),
        "distinct_words": F.size(F.array_distinct("_words")) / words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "chars_per_line": chars / lines,
        "words_per_line": words / lines,
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics; shares of an empty text are 0."""
    parts = docs.select("doc_id", text_or_empty().alias("_text")).select(
        "doc_id", "_text", F.length("_text").alias("_chars"),
        F.filter(F.split("_text", SPACES), lambda w: w != "").alias("_words"),
        F.split("_text", "\n").alias("_lines"),
    )
    safe = {k: F.when((F.col("_chars") > 0) & (F.size("_words") > 0), c).otherwise(0.0) for k, c in statistics().items()}
    return parts.select("doc_id", *[c.cast("double").alias(k) for k, c in safe.items()])


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut), all of which hold


@dataclass
class RuleEnsemble:
    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for feature, above, cut in rule:
                c = F.col(self.names[feature])
                holds = holds & ((c > cut) if above else (c <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x, cuts, residual, rows, features, path, rules, depth):
    """Best squared-error splits; every node below the root adds its path as a rule."""
    best = None
    total, count = residual[rows].sum(), len(rows)
    for f in features:
        values = x[rows, f]
        bins = np.searchsorted(cuts[f], values, side="left")
        sums = np.cumsum(np.bincount(bins, weights=residual[rows], minlength=len(cuts[f]) + 1))[:-1]
        ns = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
        ok = (ns >= 10) & (count - ns >= 10)
        if not ok.any():
            continue
        gain = np.where(ok, sums**2 / np.maximum(ns, 1) + (total - sums) ** 2 / np.maximum(count - ns, 1), -1)
        j = int(gain.argmax())
        if best is None or gain[j] > best[0]:
            best = (gain[j], f, float(cuts[f][j]))
    if best is None or best[0] <= total**2 / count + 1e-9:
        return np.full(count, total / count), rows
    _, f, cut = best
    outputs, order = [], []
    for above in (False, True):
        side = rows[(x[rows, f] > cut) == above]
        deeper = (*path, (f, above, cut))
        rules[tuple(sorted(deeper))] = None
        if depth > 1:
            values, at = _grow(x, cuts, residual, side, features, deeper, rules, depth - 1)
        else:
            values, at = np.full(len(side), residual[side].mean()), side
        outputs.append(values)
        order.append(at)
    return np.concatenate(outputs), np.concatenate(order)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        features = random.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        values, rows = _grow(x, cuts, residual, np.arange(len(y)), features, (), rules, DEPTH)
        margin[rows] += 0.8 * 4 * values
    return list(rules)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600):
    """Logistic weights with an L1 penalty on all but the intercept (accelerated proximal steps)."""
    rate = 4 * len(y) / (np.linalg.norm(z[: min(len(z), 4000)], 2) ** 2 * len(z) / min(len(z), 4000) + len(y))
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        slope = 1 / (1 + np.exp(-(z @ v + c))) - y
        moved = v - rate * (z.T @ slope) / len(y)
        w2 = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        b2 = c - rate * slope.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, above, cut in rule:
        held &= (x[:, f] > cut) == above
    return held


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    sample = F.broadcast(bounded_labels(labels, "quality", max_rows))
    rows = with_statistics(docs.join(sample.select("doc_id"), "doc_id", "left_semi")).join(sample, "doc_id")
    names = [c for c in rows.columns if c not in ("doc_id", "y")]
    single = rows.groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "y", "s.*")
    table = single.toPandas().sort_values(["doc_id"], kind="stable")
    y = table["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleEnsemble(names, float(np.log(share / (1 - share))), [])
    x = table[names].to_numpy(float)
    rules = extract_rules(x, y)
    if not rules:
        return RuleEnsemble(names, float(np.log(y.mean() / (1 - y.mean()))), [])
    z = np.stack([applies(r, x) for r in rules], 1).astype(np.float32)
    w, b = _lasso(z, y.astype(np.float32), LASSO)
    return RuleEnsemble(names, float(b), [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``."""
    scored = with_statistics(docs).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
