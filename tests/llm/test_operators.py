"""Each text operator against brute force, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from cladeloom.llm import (
    chat,
    decontamination,
    fingerprints,
    licenses,
    ngram_join,
    packing,
    pii,
    quality,
    queries,
    token_counts,
    toxicity,
)
from cladeloom.llm.components import components
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977} ab{i % 13}." for i in range(20_000))
HARD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all now", "en", "s", 1),
    (3, "same text that is said more than once today", "en", "s", 1),
    (4, "same text that is said more than once today", "en", "s", 1),
    (3, "same text that is said more than once today", "en", "s", 1),
    (5, LONG, "en", "s", 1), (6, "9" * 30_000 + "@" + "a" * 30_000, "en", "s", 1),
    (7, "a b", None, "s", 1), (8, "\U0001f600 ünï — 四 </s>[INST] x", "de", "s", 1), (9, "  \t\n ", "en", "s", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    # columns whose names the operators use themselves
    return spark.createDataFrame(
        [(*r, 1.0, "x", 2, "y") for r in HARD], DOC + ", score double, key string, n int, severity string")


@pytest.fixture(scope="module")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def operators(spark):
    bench = spark.createDataFrame([(1, "same text that is said more than once today"), (2, None), (3, "a b")],
                                  "item_id bigint, text string")
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    return {
        "fingerprints": fingerprints.neighbours,
        "ngram_join": ngram_join.join,
        "keep_first": ngram_join.keep_first,
        "packing": lambda d: packing.digest(packing.pack_documents(d, BPE)),
        "quality": lambda d: quality.score(d, quality.fit(d, no_labels)),
        "decontamination": lambda d: decontamination.search(d, bench),
        "clean": lambda d: decontamination.clean(d, bench),
        "token_counts": lambda d: token_counts.count_tokens(d, PIECES),
        "pii": lambda d: pii.find(d, pii.fit(d)),
        "redact": lambda d: pii.redact(d, pii.fit(d)),
        "licenses": lambda d: licenses.scan(d, licenses.notices(spark)),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, no_labels)),
        "reject": lambda d: toxicity.reject(d, toxicity.fit(d, no_labels)),
    }


NAMES = ["fingerprints", "ngram_join", "keep_first", "packing", "quality", "decontamination", "clean",
         "token_counts", "pii", "redact", "licenses", "toxicity", "reject"]
PER_ROW = {"fingerprints", "ngram_join", "quality", "token_counts", "pii", "redact", "toxicity", "reject"}


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows(spark, hard, name):
    rows = operators(spark)[name](hard).collect()
    if name in PER_ROW:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in HARD)
    if name == "keep_first":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    if name == "decontamination":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(3, 1), (4, 1), (7, 3)}
    if name == "clean":
        assert not {3, 4, 7} & {r["doc_id"] for r in rows}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    assert operators(spark)[name](none).collect() == []


def test_oracles(spark):
    con = connect(SF)
    for name, query in queries.QUERIES.items():
        if query.sql:
            assert compare(query.run(spark, SF), con, query.sql) == "", name


def brute_phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in fingerprints.neighbours(docs, per_range=37).collect()}
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    signs = lambda t: fingerprints.compact(fingerprints.minima(brute_phrases(t)))
    for (doc_id, text), (_, after) in zip(given, given[1:] + given[:1]):
        cut = len(text) - len(text) // 4
        edited = text[:cut] + after[: len(text) // 4]
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == signs(text).tobytes().hex() == fingerprints.fingerprint(text)
        assert row["edited_fingerprint"] == signs(edited).tobytes().hex()
        assert row["near_edited"] == (signs(text) == signs(edited)).mean()
        assert row["near_next"] == (signs(text) == signs(after)).mean()
    assert len(got) == len(given)


def test_likeness_estimates_jaccard():
    a, b = "the cat sat on the mat and ran " * 30, "the cat sat on the mat and ran " * 20 + "dogs bark loudly " * 20
    x, y = brute_phrases(a), brute_phrases(b)
    estimate = fingerprints.likeness(fingerprints.compact(fingerprints.minima(x)), fingerprints.compact(fingerprints.minima(y)))
    assert abs(estimate - len(x & y) / len(x | y)) < 0.15


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute_components(texts):
    sets = {}
    for k, text in texts.items():
        w = words(text)
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("tile, run, batch", [(4096, 1 << 20, 10_000), (7, 1 << 20, 10_000), (7, 12, 5)])
def test_ngram_join_dense_groups(spark, monkeypatch, tile, run, batch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "MAX_RUN", run)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, batch)
    random = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for k in range(160):
        w = list(base)
        for at in random.choice(150, random.integers(0, 6), replace=False):
            w[at] = f"x{random.integers(0, 40)}"
        texts[k] = " ".join(w)
    for k in range(160, 230):
        texts[k] = " ".join([f"y{k}_{i}" for i in range(random.integers(3, 200))] + passage)
    for k in range(230, 260):  # a chain: each drops a few more words
        texts[k] = " ".join(f"c{i}" for i in range((k - 230) * 6, 300))
    texts |= {260: "A b\tC", 261: "a B c", 262: "a b", 263: "", 264: None, 265: texts[3], 266: texts[3]}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id bigint, text string").repartition(5)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table).collect()}
    finally:
        spark.conf.set(size, usual)
    assert got == brute_components(texts)


def test_keep_first_of_repeated_ids(spark):
    copied, other, third = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    rows = [(3, copied), (5, copied), (5, other), (5, None), (6, third), (6, third.upper()), (6, other), (7, ""), (7, ""),
            (None, copied)]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(
        [(3, copied), (5, other), (5, None), (6, third.upper()), (7, ""), (None, copied)])


def test_bitmaps_bound_the_overlap():
    random = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(random.integers(0, 2**63, random.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([random.choice(a, len(a) // 2), random.integers(0, 2**63, 50, dtype=np.uint64)]))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        width = min(len(x), len(y))
        most = ngram_join.shared_bound(ngram_join.folded(x, width), len(a), ngram_join.folded(y, width), len(b))
        assert most >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("small", [0, 60, 10_000])
def test_components_of_paths_and_stars(spark, small):
    """By rounds only, by rounds and one task, in one task."""
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint"), small).collect()
    assert len(rows) == 101
    roots = {r["node"]: r["root"] for r in rows}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 140)}) == 1
    assert len(set(roots.values())) == 2


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(-1, "x <|endoftext|> y", "", "", 1), (-2, None, "", "", 0)], DOC)
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    pieces = packing.pack_documents(given, BPE)
    rows, digests = pieces.collect(), {(r["doc_id"], r["start"]): r for r in packing.digest(pieces).collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert digests[r["doc_id"], r["start"]]["ids_crc32"] == zlib.crc32(r["ids"])
    for r in given.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == np.array(ids, "<u4").tobytes()
        assert [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        assert {p["doc_tokens"] for p in parts} == {len(ids)}
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        total = sum(p["length"] for p in parts)
        assert total <= 2048 and total & (total - 1) == 0


def test_fill_is_the_best_sum():
    random = np.random.default_rng(1)
    for _ in range(200):
        counts = [0] + random.integers(0, 3, 12).tolist()
        capacity = int(random.integers(1, 40))
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums}
        chosen = packing.fill(counts, capacity)
        assert sum(a * b for a, b in chosen) == max(s for s in sums if s <= capacity)
        used = Counter()
        for a, b in chosen:
            used[a] += b
        assert all(counts[a] >= b for a, b in used.items())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    good = [r["score"] for r in rows if truth[r["doc_id"]]]
    bad = [r["score"] for r in rows if not truth[r["doc_id"]]]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    print("quality held out", right / len(rows), auc)
    assert right / len(rows) > 0.95 and auc > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    rows = toxicity.score(docs, model).join(labels.filter("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    right = np.mean([(r["p_toxic"] >= 0.5) == bool(truth[r["doc_id"]]) for r in rows])
    print("toxicity held out", right, len(rows))
    assert right > 0.95
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES - 1


def brute_tokens(word, pieces, byte_cost):
    marked = token_counts.MARK + word
    best = [(0.0, 0)]
    for at in range(1, len(marked) + 1):
        size = len(marked[at - 1].encode())
        options = [(best[at - 1][0] + byte_cost * size, best[at - 1][1] + size)]
        for start in range(at):
            if marked[start:at] in pieces:
                options.append((best[start][0] + pieces[marked[start:at]], best[start][1] + 1))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(spark, docs):
    pieces = token_counts.load_pieces(PIECES)
    byte_cost = -math.log(len(pieces) + 2) - 1.0
    cache = {}
    for r in token_counts.count_tokens(docs, PIECES, memory=3000).join(docs.select("doc_id", "text"), "doc_id").collect():
        split = r["text"].split()
        for w in split:
            if w not in cache:
                cache[w] = brute_tokens(w, pieces, byte_cost)
        assert (r["n_tokens"], r["n_pretokens"], r["n_chars"]) == (sum(map(cache.get, split)), len(split), len(r["text"]))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                ok = 13 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, docs):
    made = ["a@b.c_d@e.f x@y z@@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4 1.2.3", "4111 1111-1111 1111 4111111111111112",
            "+1 (988) 555-2485 +12 +1+2 3456789 +123456789012345678", "\U0001f600 me@x.org, 10.0.0.1!", "5" * 40, "a.b.c@d-e.f..g@h.i"]
    extra = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(made)], "doc_id bigint, text string")
    given = docs.select("doc_id", "text").unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    for r in pii.find(given, pii.fit(given)).collect():
        spans = brute_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(listed.split(",")) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]


def test_redaction_leaves_no_span(spark):
    given = spark.createDataFrame([(1, "write to a@b.com or call +1 (988) 555-2485 now", 3)], "doc_id bigint, text string, _n int")
    row = pii.redact(given, pii.SpanModel()).first()
    assert row["text"] == "write to <EMAIL> or call <PHONE> now" and row["_n"] == 3


def test_long_secrets_are_masked_whole(spark):
    values = ["Ab1_" * 75, "eyJhbGciOiJI.eyJzdWIi~MTIz.c2ln==", "Ab1." * 50_000]
    texts = [f"login token: {v} end" for v in values] + ["number " + "12 34" * 20 + " end", "number " + "7" * 100_000 + " end"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["text"] for r in pii.redact(given, pii.SpanModel(bias=1.0)).orderBy("doc_id").collect()]
    assert got == ["login <CREDENTIAL> end"] * 3 + ["number <NUMBER> end"] * 2


def test_decontamination(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    bench = {r["item_id"]: " ".join(plain(r["text"])) for r in items.collect()}
    texts = {r["doc_id"]: " " + " ".join(plain(r["text"])) + " " for r in docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, b in bench.items() if f" {b} " in t}
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.search(docs, items).collect()}
    assert whole <= found.keys() and all(s >= 0.8 for s in found.values())
    edited = bench[0].split()
    edited = " ".join(["lead"] * 9 + edited[:-1] + ["tail"] * 4)
    made = spark.createDataFrame([(1, edited), (2, " ".join(reversed(edited.split())))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in decontamination.search(made, items).collect()} == {1}


def test_clean_keeps_other_rows_of_an_id(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, f"so {item} so"), (None, "clean without an id"), (None, None), (7, item), (7, "clean seven"),
            (7, item), (8, "clean eight")]
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in decontamination.clean(given, bench).collect())
    assert kept == Counter(r for r in rows if item not in (r[1] or ""))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.search(given, bench).collect()} == {(None, 1), (7, 1)}


def test_chat_masks(spark):
    rows = [(1, 0, "system", "be ~nice~"), (1, 1, "user", "a\n<b>"), (1, 2, "assistant", "</s>[INST] "), (1, 3, "user", None),
            (1, 4, "assistant", "ok"), (1, 5, "us\ner", "late"), (2, None, None, None), (None, 0, "assistant", "x"), (2, None, None, None)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_context int")
    examples = chat.format_examples(turns)
    got = sorted(((r["conv_id"] or 0), r["n_context"], r["trained"]) for r in examples.collect())
    assert got == [(0, 1, True), (1, 3, True), (1, 5, True), (1, 6, False), (2, 2, False)]
    for r in examples.collect():
        assert r["text"].count(chat.CLOSE) == r["n_context"] == r["text"].count(chat.OPEN)
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert back[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert back[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok").hexdigest()
    assert chat.format_examples(turns.limit(0)).collect() == []


def test_waiting_pieces_hold_only_their_ids():
    packer = packing.Packer(0)
    for k in range(20_000):
        packer.add(k, np.arange(2049, dtype="<u4"))
        packer.pieces.clear()
    held = [p.ids for row in packer.waiting for p in row]
    assert sum(len(i) for i in held) == packer.total
    assert sum((i if i.base is None else i.base).nbytes for i in held) < 20_000_000


def test_redaction_with_clashing_names(spark):
    given = spark.createDataFrame([(1, "write to a@b.com", "keep me", "x", "y", "z")],
                                  "doc_id bigint, text string, _text string, _BASE string, _all string, _own0 string")
    row = pii.redact(given, pii.SpanModel()).first()
    assert tuple(row) == (1, "write to <EMAIL>", "keep me", "x", "y", "z") and row.__fields__ == given.columns
