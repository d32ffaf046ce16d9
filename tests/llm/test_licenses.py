"""License scans: real notices however they are wrapped, and all units against brute force."""

import re
import textwrap
from collections import Counter

import pytest

from cladeloom.llm import licenses

REAL = {}
for _license, _text in licenses.TEXTS:
    REAL.setdefault(_license, []).append(_text)


def brute_units(text):
    text = re.sub(r"\n[ \t\r]*\n", "\x03", (text or "").lower())
    text = re.sub(r"([.!?])[ \t\r\n]+", "\\1\x01", text)
    for paragraph in text.split("\x03"):
        clean = lambda s: " ".join(re.findall(r"[^\W_]+", s))
        said = [s for s in paragraph.split("\x01") if clean(s)]
        if len(said) > 1:
            yield clean(paragraph)
        for sentence in said:
            yield clean(sentence)
            if "\n" in sentence:
                yield from map(clean, sentence.split("\n"))


def brute_pairs(text):
    for unit in brute_units(text):
        words = unit.split()
        if len(words) > 1:
            yield frozenset(zip(words, words[1:]))


def brute_scan(docs, templates, threshold=licenses.THRESHOLD):
    wanted = {(name, pairs) for name, text in templates for pairs in brute_pairs(text)}
    found, best = Counter(), {}
    for doc_id, text in docs:
        for unit in brute_pairs(text):
            for name, pairs in wanted:
                dice = 2 * len(unit & pairs) / (len(unit) + len(pairs))
                if dice >= threshold:
                    found[doc_id, name] += 1
                    best[doc_id, name] = max(dice, best.get((doc_id, name), 0))
    return {key: (n, round(best[key], 9)) for key, n in found.items()}


def variants(text):
    wrapped = textwrap.fill(text, 70)
    return [text, wrapped, textwrap.indent(wrapped, "# "), "Intro line one.\n\n" + wrapped + "\n\nint main() { return 0; }"]


def rows():
    out, names = [], {}
    for name, texts in REAL.items():
        for text in [*texts, "\n\n".join(texts), "Copyright 2020 Somebody\n\n" + "\n\n".join(texts)]:
            for variant in variants(text) if "\n" not in text else [text]:
                names[len(out)] = name
                out.append((len(out), variant))
    clean = ["We license nothing here. The sun rose over the hills and the permission slip was lost.", "", None, "a b", "  \n\n ",
             "x " * 3000, "The software is provided by our office on request.\nAsk at the desk."]
    return out + [(1000 + k, t) for k, t in enumerate(clean)], names


def got(scanned):
    return {(r["doc_id"], r["license_id"]): (r["n_matches"], round(r["best_dice"], 9)) for r in scanned.collect()}


@pytest.mark.parametrize("known", [10_000, 3])
def test_real_notices(spark, monkeypatch, known):
    monkeypatch.setattr(licenses, "MAX_KNOWN", known)
    given, names = rows()
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    found = got(licenses.scan(docs, licenses.notices(spark)))
    for doc_id, name in names.items():
        assert (doc_id, name) in found, (name, given[doc_id][1])
    assert not [key for key in found if key[0] >= 1000]
    assert found == brute_scan(given, licenses.NOTICES + licenses.TEXTS)


def test_no_templates_and_hard_rows(spark):
    mit = REAL["MIT"][0]
    given = [(None, mit), (None, mit), (1, "\x01\x02\x03"), (2, mit + "\x00" * 3), (3, "9" * 50_000), (4, mit.upper())]
    docs = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id bigint, text string, pairs string, n int")
    found = got(licenses.scan(docs, licenses.notices(spark)))
    assert found == {(None, "MIT"): (2, 1.0), (2, "MIT"): (1, 1.0), (4, "MIT"): (1, 1.0)}
    assert licenses.scan(docs, licenses.notices(spark).limit(0)).collect() == []


def test_every_match_holds_an_anchor():
    """Whatever two thirds of a template's bigrams a unit has, one of its anchors is among its words."""
    import random

    draw = random.Random(4)
    for _, text in licenses.NOTICES + licenses.TEXTS:
        for pairs in brute_pairs(text):
            named = sorted(" ".join(p) for p in pairs)
            anchors = licenses.anchor_words(named, licenses.THRESHOLD)
            least = -(-2 * len(named) // 3)
            free = [p for p in named if not anchors & set(p.split())]
            assert len(free) < least
            assert anchors & {w for p in draw.sample(named, least) for w in p.split()}
