"""Decontamination against brute force over all item-sized windows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.llm import decontamination

RNG = np.random.default_rng(8)
WORDS = [a + b for a in "bcdfghklmnpr" for b in ("a", "e", "in", "or", "un")]
ITEMS = [list(RNG.choice(WORDS, n)) for n in (14, 30, 30, 30, 60)]


def shingles(words, k):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def best(words, item):
    k = min(5, len(item))
    theirs, n, most = shingles(item, k), len(item), 0.0
    for start in range(len(words)):  # shorter ones at the end
        ours = shingles(words[start:start + n], k)
        most = max(most, sum((ours & theirs).values()) / max(1, sum((ours | theirs).values())))
    return most


def brute(texts):
    return {(d, i): s for d, words in texts.items() for i, item in enumerate(ITEMS) for s in [best(words, item)] if s >= 0.8}


def table(spark, texts, column, name):
    return spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], f"{name} bigint, {column} string")


@pytest.fixture(scope="module")
def items(spark):
    return table(spark, dict(enumerate(ITEMS)), "text", "item_id")


def test_every_similar_window(spark, items):
    """Edited, shuffled in halves, repeated, cut and overlapping passages: recall and precision against all windows."""
    texts, d = {}, 0
    for item in ITEMS:
        for _ in range(60):
            words = list(item)
            for at in RNG.integers(0, len(words), RNG.integers(0, 3)):
                words[at] = RNG.choice(WORDS)
            if RNG.random() < 0.3:
                cut = int(RNG.integers(1, len(words)))
                words = words[cut:] + words[:cut]
            lead, tail = (list(RNG.choice(WORDS, RNG.integers(0, 40))) for _ in range(2))
            texts[d] = lead + words + tail if RNG.random() < 0.9 else words[:-1]
            d += 1
    for _ in range(80):  # one word of the longest changed: between 0.83 and 0.85
        words = list(ITEMS[4])
        words[RNG.integers(6, 54)] = "other"
        texts[d] = ["lead"] * 5 + words
        d += 1
    want = brute(texts)
    near = {p for p, s in want.items() if s < 0.85}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in
           decontamination.search(table(spark, texts, "text", "doc_id"), items).collect()}
    assert got.keys() <= want.keys() and all(abs(want[p] - s) < 1e-9 for p, s in got.items())
    assert len(near) > 80 and len(near & got.keys()) >= 0.9 * len(near)
    assert len(got) >= 0.99 * len(want)


def test_rotated_item(spark, items):
    item = ITEMS[4]
    words = ["lead"] * 12 + item[30:] + item[:30] + ["tail"] * 9
    got = decontamination.search(table(spark, {1: words}, "text", "doc_id"), items).collect()
    assert [(r["item_id"], round(r["similarity"], 9)) for r in got] == [(4, round(52 / 60, 9))]


def test_dense_stretches_cover_every_size():
    sizes = list(range(1, 400, 3))
    found = decontamination.dense_stretches(sizes)
    for m in sizes:
        assert any(marks <= -(-8 * m // 9) and m <= span for marks, span in found)


@pytest.mark.parametrize("few", [True, False])
def test_clashing_names_and_large_hit_tables(spark, items, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_ROWS", 0)
    rows = [(1, " ".join(["so", *ITEMS[1]]), "x"), (2, "clean text of a few words", "y"), (None, None, "z"), (None, " ".join(ITEMS[0]), "w")]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, _hit string")
    for name in ("_id", "_digest", "_ID_", "k", "n", "hashes", "digest", "start", "h", "pos"):
        given = given.withColumn(name, F.lit("clash"))
    kept = decontamination.clean(given, items)
    assert kept.columns == given.columns
    assert {(r["doc_id"], r["_hit"], r["_digest"]) for r in kept.collect()} == {(2, "y", "clash"), (None, "z", "clash")}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.search(given, items).collect()} == {(1, 1), (None, 0)}
