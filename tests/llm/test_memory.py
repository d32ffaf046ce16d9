"""What a task of the pipeline holds at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from cladeloom.llm import byte_bpe, ngram_join, toxicity

DRAW = np.random.default_rng(3)
TEXTS = [" ".join(map(str, DRAW.integers(0, 40, 1500))) for _ in range(700)]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(TEXTS), pa.array([1] * 700, pa.int32())],
                                   names=["doc_id", "text", "y"])


class _Task:
    """In place of a table: keeps the function that a task runs."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *args, **kwargs: self


@pytest.fixture
def task(monkeypatch):
    monkeypatch.setattr(ngram_join, "_rows", lambda docs: docs)
    for module in (ngram_join, toxicity):
        monkeypatch.setattr(module, "F", _Task())
    monkeypatch.setattr(toxicity, "text_or_empty", _Task)
    return _Task()


def test_ranges_have_every_hash_once(monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 100)
    sets = [np.unique(DRAW.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in (0, 1, 300, 5, 900)]
    sets += [sets[2], np.array([0, (1 << 64) - 1], np.uint64)]
    parts = [np.sort(p) for p in ngram_join.by_ranges(sets)]
    assert max(map(len, parts)) < 300 and list(ngram_join.by_ranges([])) == []
    assert np.array_equal(np.concatenate(parts), np.sort(np.concatenate(sets)))
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))


def test_shingles_are_counted_in_parts(task):
    """No copy of all sets of a batch beside the sets; the counts are those of all."""
    texts = TEXTS[:300] + [t + end for end in (" x", " y", " z") for t in TEXTS[:200]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    held = np.concatenate([ngram_join.shingles(t) for t in texts])
    ngram_join.describe(task)
    tracemalloc.start()
    try:
        out = list(task.run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(held) > 1_000_000 and peak < 2.5 * held.nbytes
    values, counts = np.unique(held, return_counts=True)
    found = pa.Table.from_batches(out).filter(pc.field("h").is_valid())
    assert found.num_rows == (counts > 2).sum()
    assert dict(zip(found["h"].to_pylist(), found["seen"].to_pylist())) == {
        int(v): int(c) for v, c in zip(values.view(np.int64), counts) if c > 2}


def test_sets_go_in_parts(task, monkeypatch):
    monkeypatch.setattr(ngram_join, "metric", lambda wanted: 0)
    keys = [ngram_join.class_key(ngram_join.shingles(t)) for t in TEXTS]
    keys[5] = b"?"
    ngram_join._hashes(task, task)
    out = list(task.run(iter([pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(keys)], names=["text", "key"])])))
    assert max(sum(map(len, b["hashes"].to_pylist())) for b in out) < 8 * (ngram_join.PART + 2_000)
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"key": k, "hashes": ngram_join.shingles(t).tobytes()} for k, t in zip(keys, TEXTS) if k != b"?"]


def test_words_of_labelled_texts_go_in_parts(task):
    toxicity._sample_words(task, task)
    many = [pa.RecordBatch.from_arrays([BATCH["doc_id"], pa.array([" ".join(f"w{k}x{j}" for j in range(300)) for k in range(700)]),
                                        BATCH["y"]], names=["doc_id", "text", "y"])]
    out = list(task.run(iter(many)))
    assert max(b.num_rows for b in out) <= toxicity.WORDS + 300
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(k, 1, f"w{k}x{j}", 1) for k in range(700) for j in range(300)]


def test_encoder_keeps_what_the_caller_allows():
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(f"q{k}z" for k in range(900)), "one"])],
                                       names=["doc_id", "text"])
    kept = {}
    for cache in (1_000, byte_bpe.CACHE):
        rows = list(byte_bpe.encoded(batch, path, 1, cache))
        assert [ids.tobytes() for _, ids in rows] == [
            byte_bpe.encoder_of(path, cache).encode_whole(t) + np.array([1], "<u4").tobytes() for t in batch["text"].to_pylist()]
        kept[cache] = len(byte_bpe.encoder_of(path, cache)._known)
    assert kept[1_000] < 50 and kept[byte_bpe.CACHE] > 900
    assert byte_bpe.encoder_of(path) is byte_bpe.encoder_of(path, byte_bpe.CACHE)
