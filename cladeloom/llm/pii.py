"""Personal data by aggregated weak supervision.

Regular expressions find candidate spans: the base kinds (email, ip, card,
phone), which always stay, and looser ones (credentials, other long numbers).
Labelers vote on each candidate: strict form, gazetteer, words before it, its
borders, and its make-up. Expectation-maximisation over the counted vote patterns
estimates how reliable each labeler is and how likely a candidate of each pattern
is personal data; a logistic span classifier is trained on these soft labels and
compiled into a column expression, which decides about the looser candidates.

Only counts of vote patterns, at most ``MAX_PATTERNS``, reach the driver; spans
are found and judged inside the row by JVM expressions.

Defined results: a null text is an empty one without spans; repeated rows are
judged each for itself; an empty table has no spans and adds none; other columns
are ignored by ``find`` and kept by ``redact``. Offsets are code points, ends
exclusive. Spans of different kinds may overlap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import text_or_empty
from cladeloom.llm.decontamination import unused

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["credential", "number"]
VOTES = ["strict", "listed", "context", "border", "makeup"]
MAX_PATTERNS = len(BASE + LOOSE) * 3 ** len(VOTES) * 4

# A match starts where the last one ended or where no character of its first part
# stands before: elsewhere the same run has failed already. Possessive repeats
# give the same matches as greedy ones here and need neither stack nor retries.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "credential": r"(?i)(?<![a-z])(?:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_/+.=~-]{8,}+\"?",
    "number": r"(?:\G|(?<![0-9]))[0-9](?:[\x20./()-]?[0-9]){6,}+(?![0-9])",
}

# Common endings of mail hosts, calling codes and words that announce a value.
ENDINGS = ["com", "de", "edu", "es", "fr", "gov", "info", "io", "net", "org", "uk"]
CALLING = ["1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91"]
CUES = {
    "email": "mail|contact|write|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "credential": "login|user|account|auth",
    "number": "number|account|iban|passport|phone|tel|id",
}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda span: valid(kind, span["value"])


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, span: Column) -> dict[str, Column]:
    value, digits = span["value"], digits_of(span["value"])
    before = F.lower(F.substring(text, F.greatest(span["start"] - 24, F.lit(0)) + 1,
                                 F.least(span["start"], F.lit(24))))
    left = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(" ")
    right = F.substring(text, span["end"] + 1, F.lit(1))
    listed = {
        "email": F.substring_index(F.lower(value), ".", -1).isin(ENDINGS),
        "ip": ~F.substring_index(value, ".", 1).isin("0", "10", "127", "255"),
        "card": F.substring(digits, 1, 1).isin("3", "4", "5", "6"),
        "phone": F.lit(False) | F.substring(digits, 1, 1).isin(CALLING) | F.substring(digits, 1, 2).isin(CALLING),
        "credential": F.lower(value).rlike("password|token|secret"),
        "number": F.substring(digits, 1, 2).isin(CALLING),
    }[kind]
    borders = left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]")
    mixed = F.length(digits) * 2 >= F.length(value) if kind != "credential" else value.rlike("[0-9].*[a-z]|[a-z].*[0-9]")
    strict = F.lit(1) if kind in BASE else F.lit(0) if kind == "credential" else F.lit(-1)
    return {
        "strict": strict,
        "listed": _vote(listed, ~listed),
        "context": _vote(before.rlike(f"({CUES[kind]})[^a-z]*$"), F.lit(False)),
        "border": _vote(~borders, borders),
        "makeup": _vote(mixed, ~mixed) if kind not in ("email",) else F.lit(0),
    }


def _judged(kind: str, text: Column, spans: Column) -> Column:
    def one(span):
        size = F.when(span["end"] - span["start"] < 10, 0).when(span["end"] - span["start"] < 16, 1).when(
            span["end"] - span["start"] < 24, 2).otherwise(3)
        votes = [v.cast("int").alias(k) for k, v in _votes(kind, text, span).items()]
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                        *votes, size.cast("int").alias("size"))

    return F.transform(spans, one)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text``, ``_base`` and ``_loose`` (judged spans)."""
    text = F.col("_text")
    found = docs.withColumn("_text", text_or_empty())
    base = {k: F.filter(matches(text, PATTERNS[k]), _valid_span(k)) for k in BASE}
    found = found.withColumn("_base", F.concat(*[_judged(k, text, base[k]) for k in BASE]))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    loose = {k: F.filter(matches(text, PATTERNS[k]), free) for k in LOOSE}
    return found.withColumn("_loose", F.concat(*[_judged(k, text, loose[k]) for k in LOOSE]))


@dataclass
class SpanModel:
    """Weights of the features of a span: its kind, votes and size."""

    bias: float = -1.0
    weights: dict[tuple[str, object], float] = field(default_factory=dict)
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def accepts(self, span: Column) -> Column:
        total = F.lit(self.bias)
        for (name, value), weight in self.weights.items():
            total = total + F.when(span[name] == F.lit(value), weight).otherwise(0.0)
        return total > 0


def _expectation_maximisation(kinds, votes, counts, rounds: int = 60):
    """P(personal data) of each pattern, and each labeler's hit and false alarm rates."""
    prior = {k: 0.5 for k in set(kinds)}
    hit, alarm = np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.2)
    cast = votes != 0
    for _ in range(rounds):
        odds = np.array([math.log(prior[k] / (1 - prior[k])) for k in kinds])
        up, down = np.log(hit / alarm), np.log((1 - hit) / (1 - alarm))
        odds = odds + np.where(votes > 0, up, 0).sum(1) + np.where(votes < 0, down, 0).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        yes, no = (counts * p)[:, None], (counts * (1 - p))[:, None]
        hit = np.clip(((yes * (votes > 0)).sum(0) + 2) / ((yes * cast).sum(0) + 3), 0.05, 0.99)
        alarm = np.clip(((no * (votes > 0)).sum(0) + 1) / ((no * cast).sum(0) + 3), 0.01, 0.95)
        for k in prior:
            at = kinds == k
            prior[k] = float(np.clip((counts[at] * p[at]).sum() / counts[at].sum(), 0.02, 0.98))
    return p, hit, alarm


def fit(docs: DataFrame) -> SpanModel:
    """Reliabilities and span classifier from all candidates of all documents."""
    names = ["kind", *VOTES, "size"]
    spans = with_candidates(docs).select(F.explode(F.concat("_base", "_loose")).alias("s")).select("s.*")
    rows = spans.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).limit(MAX_PATTERNS).collect()
    if not rows:
        return SpanModel()
    kinds = np.array([r["kind"] for r in rows])
    votes = np.array([[r[v] for v in VOTES] for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    p, hit, alarm = _expectation_maximisation(kinds, votes, counts)
    features = sorted({(n, r[n]) for r in rows for n in names}, key=str)
    x = np.array([[float(r[n] == v) for n, v in features] for r in rows])
    w, b = np.zeros(len(features)), 0.0
    share = counts / counts.sum()
    for _ in range(3000):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - p) * share
        w -= 0.5 * (x.T @ slope + 1e-4 * w)
        b -= 0.5 * slope.sum()
    rates = {v: (float(hit[k]), float(alarm[k])) for k, v in enumerate(VOTES)}
    return SpanModel(float(b), {f: float(v) for f, v in zip(features, w)}, rates)


def _listed(spans: Column) -> Column:
    order = F.array(*map(F.lit, BASE + LOOSE))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"], s["end"], s["kind"]))
    texts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(texts, ",")


def _with_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    found = with_candidates(docs)
    return found.withColumn("_all", F.concat("_base", F.filter("_loose", model.accepts)))


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Counts, digest and list of spans, one row per row of ``docs``."""
    found = _with_spans(docs.select("doc_id", "text"), model)
    counts = [
        F.size(F.filter("_base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE
    ]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
                        _listed(F.col("_all")).alias("spans"))


WORKING = {"_text", "_base", "_loose", "_all"}  # columns in use here


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets, whatever other columns it has."""
    own = {c: unused(docs, f"_own{k}") for k, c in enumerate(docs.columns) if c.lower() in WORKING}
    given = docs.withColumnsRenamed(own)
    text, start = F.col("_text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.concat(acc["out"], kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        inside = s["end"] <= acc["at"]
        touching = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside | touching, acc["out"]).otherwise(more).alias("out"),
        )

    spans = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    changed = F.when(F.size("_all") > 0, done).otherwise(F.col("text"))
    masked = _with_spans(given, model).withColumn("text", changed)
    return masked.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
