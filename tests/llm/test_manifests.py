"""Collocations, Merkle manifest and token files against plain Python."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladeloom.llm import automata, collocations, merkle, token_files
from cladeloom.llm.byte_bpe import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word, " * 30_000
HARD = [
    (3, "An odd, odd text", "en", "web", 16), (None, "no id", "en", "web", None), (None, "no id", None, None, 5),
    (1, None, "en", "web", 0), (1, "", "en", None, 0), (7, LONG, "fr", "b", len(LONG)), (7, "Twin", "", "b", 4),
    (7, "Twin", "", "b", 4), (12, "ünï ✓ <|endoftext|>\x00", "en", "é", 9), (-5, "A", None, "x", 1),
]
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["tree", "hash", "pos", "size", "_row", "_hash", "ids", "head", "data", "h", "start", "word", "total", "_at"]


@pytest.fixture(scope="module")
def hard(spark):
    table = spark.createDataFrame(HARD, NAMES)
    return table.select("*", *[F.lit("clash").alias(c) for c in CLASH])


# --- token files


@pytest.mark.parametrize("text", [
    "<|endoftext|>a <|endoftext|>", "  a  \n\n b\t\t", "it's we'll ''s !'s  'S", "\x1c a\x1d", "a­b ª", "½ ² x²  \x85 y",
    "Ǆ ƻ ǂ ʰ", "x" * 3000 + " " * 500 + "é" * 99, "", "‘s’s … a₰b", "a\x7fb", "1²3¼ 12345 _a_", "ß ß   x", "汉字 テスト 🙂🙂",
])
def test_ids_of_odd_texts(text):
    encoder = Encoder(BPE)
    assert encoder.encode(text) == encoder.encode(text) == encoder.encode_whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab Z9'sdm.,-_\n\t é²ªʰ’€\x1f"), max_size=40))
def test_ids_of_any_text(text):
    assert ENCODER.encode(text) == ENCODER.encode_whole(text)


ENCODER = Encoder(BPE, cache=2_000)


def expected_stream(rows):
    library = Tokenizer.from_file(BPE)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in order]


@pytest.mark.parametrize("size", [1, 500, 1 << 26])
def test_token_files_round_trip(spark, hard, size):
    manifest = token_files.write_files(hard, BPE, length=16, rows=4, file_tokens=size)
    got = token_files.read_documents(manifest).orderBy("start").collect()
    want = expected_stream(HARD)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == Counter(
        (w[0], tuple(w[1])) for w in want)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    files = manifest.orderBy("part", "number").collect()
    assert sum(f["documents"] for f in files) == len(HARD)
    stream = []
    for f in files:
        opened = token_files.TokenFile(f["path"])
        assert len(opened) == f["sequences"]
        for k in range(len(opened)):
            ids, mask = opened.sequence(k)
            assert len(ids) == len(mask) == 16
            assert not ids.flags.owndata and not ids.flags.writeable
            stream.extend(ids[np.array(mask)].tolist())
        with pytest.raises(IndexError):
            opened.sequence(len(opened))
    assert stream == list(itertools.chain(*[np.frombuffer(r["ids"], "<u4").tolist() for r in got]))


def test_sequences_by_number(spark, hard):
    manifest = token_files.write_files(hard, BPE, length=16, rows=4, file_tokens=300)
    total = manifest.agg(F.sum("sequences")).first()[0]
    wanted = spark.createDataFrame([(0,), (3,), (3,), (total - 1,), (total,), (-1,), (None,)], "sequence bigint")
    got = {r["sequence"]: r for r in token_files.read_sequences(spark, manifest, wanted).collect()}
    assert sorted(got) == [0, 3, total - 1]
    flat = [token_files.TokenFile(f["path"]).sequence(k)[0].tolist()
            for f in manifest.orderBy("part", "number").collect() for k in range(f["sequences"])]
    assert all(got[k]["ids"] == flat[k] and sum(got[k]["mask"]) > 0 for k in got)


def test_sequences_are_mapped_not_copied(tmp_path):
    schema = token_files.sequence_schema(8, 50_257)
    writer = token_files.FileWriter(f"file://{tmp_path}/a.arrow", schema, 2)
    writer.add(4, np.arange(37, dtype="<u4"))
    writer.close()
    assert schema.field("ids").type.value_type == pa.uint16()
    before = pa.total_allocated_bytes()
    opened = token_files.TokenFile(f"file://{tmp_path}/a.arrow")
    ids, mask = opened.sequence(4)
    assert pa.total_allocated_bytes() - before < 8 * 2
    assert ids.tolist() == [32, 33, 34, 35, 36, 0, 0, 0] and mask.to_pylist() == [True] * 5 + [False] * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], NAMES)
    assert token_files.read_documents(token_files.write_files(none, BPE)).count() == 0
    assert merkle.proofs(merkle.build(none)).count() == 0
    assert collocations.mine(none).count() == 0


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, low):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def reduced(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    found = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        found.append((level[lo:at], level[at + 1:lo + 8]))
        at //= 8
    return found


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    members = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, False)))
               for v in langs}
    trees = {v: reduced([plain_leaf(r, False) for r in members[v]]) for v in langs}
    top = reduced([trees[v][-1][0] for v in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, row in enumerate(members[lang]):
            steps = path(trees[lang], at) + path(top, place)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            reached = plain_leaf(row, hit)
            for left, right in steps:
                reached = H(*left, reached, *right)
            proof = H(*[h for left, right in steps for h in left + right])
            out.append((row[0], trees[lang][0][at], trees[lang][-1][0], top[-1][0], proof, reached,
                        reached == top[-1][0], len(steps) if hit else 0))
    return Counter(out)


def manifest_rows(table):
    return Counter(map(tuple, merkle.proofs(merkle.build(table, merkle.tampered(), merkle.folded_text())).collect()))


def test_merkle_equals_plain(hard):
    assert manifest_rows(hard) == plain_manifest(HARD)


def test_merkle_of_two_tiers_and_many_languages(spark):
    rows = [(k * 7 % 9001, f"Text {k}", "en" if k < 4200 else f"l{k % 90}", "s", k) for k in range(4600)]
    table = spark.createDataFrame(rows, NAMES).repartition(5)
    assert manifest_rows(table) == plain_manifest(rows)


def test_untampered_rows_verify(hard):
    assert merkle.proofs(merkle.build(hard)).filter("NOT verified OR copied > 0").count() == 0


def test_versions_share_untouched_nodes():
    hashes = [H(str(k)) for k in range(100)]
    tree = merkle.BlockTree(hashes, 3)
    version = tree.changed(70, H("new"))
    def nodes(node):
        yield node
        for child in node.children:
            yield from nodes(child)
    old = {id(n) for n in nodes(tree.root)}
    fresh = [n for n in nodes(version) if id(n) not in old]
    assert len(fresh) == 4  # the leaf and its three ancestors
    assert version.hash == reduced(hashes[:70] + [H("new")] + hashes[71:])[-1][0]
    assert tree.root.hash == reduced(hashes)[-1][0]  # the first version stays


# --- collocations

WORDS = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"cc"]), max_size=4).map(tuple), st.integers(1, 9)), max_size=12)


def built(pairs):
    counts = Counter()
    for phrase, weight in pairs:
        counts[phrase] += weight
    builder = automata.Builder()
    for phrase in sorted(counts):
        builder.add(phrase, counts[phrase])
    return builder.finish(), counts


def weights(automaton):
    return {p: w for p, w in automaton.phrases() if w}


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS)
def test_automata(parts, query):
    made = [built(p) for p in parts]
    whole = automata.union([automata.Automaton.unpack(a.pack()) for a, _ in made])
    total = sum((c for _, c in made), Counter())
    assert weights(whole) == dict(total)
    phrases = [p for p, _ in whole.phrases()]
    assert phrases == sorted(phrases)
    assert len(set(whole.states[:-1])) == len(whole.states) - 1  # no two states alike
    kept = weights(automata.pruned(whole, 6))
    assert {p: w for p, w in kept.items() if p} == {p: w for p, w in total.items() if w >= 6 and p}
    asked, wanted = built(query)
    answer, alike = automata.composed(asked, whole)
    prefixes = {p[:k] for p in total for k in range(len(p) + 1)} | {()}
    assert {p for p, _ in answer.phrases()} == {q[:k] for q in wanted for k in range(len(q) + 1) if q[:k] in prefixes} | {()}
    assert all(w == total[p] for p, w in answer.phrases())
    assert set(alike) == {p for p, w in wanted.items() if total[p] == w}


def plain_collocations(rows, least, top):
    counts = {}
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\v\f\r":
            low = low.replace(mark, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for m in range(1, 6):
                for k in range(len(words) - m + 1):
                    counts.setdefault("und" if lang is None else lang, Counter())[tuple(words[k:k + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[k:k + len(p)] == p for k in range(len(q))))
            if any(100 * found[q] >= 100 * a for q in inside):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return Counter(out)


def test_collocations_equal_plain(spark, hard):
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "new", "york", "é", "x y", "A", "a"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(60)),
             [None, "en", "und", "fr"][k % 4], "s", 0) for k in range(40)]
    rows += [(50 + k, "new york new york new york city hall of the city", "en", "s", 0) for k in range(6)] + HARD
    table = spark.createDataFrame(rows, NAMES).unionByName(hard.limit(0).select(*[c.split()[0] for c in NAMES.split(", ")]))
    table = table.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(6)
    got = Counter(map(tuple, collocations.mine(table, least=3, top=50).collect()))
    assert got == plain_collocations(rows, 3, 50)


def test_word_hash_is_that_of_spark(spark):
    rows = [("en", "wörd"), ("und", "x")]
    got = spark.createDataFrame(rows, "lang string, word string").select(F.xxhash64("lang", "word").alias("h")).collect()
    assert [r["h"] % 2**64 for r in got] == [collocations.word_hash(a, b.encode()) for a, b in rows]
