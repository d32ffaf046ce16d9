"""Ids of many texts at once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeloom.llm.byte_bpe import Encoder, encoded, encoder_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(BPE, cache=2_000)
PARTS = st.text(st.sampled_from("ab Z9'sdmtrevl.,_\n\t  ''éß×’²\x1f"), max_size=12)
SPECIAL = st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'", " ", "ll", "'s"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS | SPECIAL, max_size=5).map("".join), max_size=8), st.sampled_from([1, 9, 1 << 20]))
def test_ids_of_neighbouring_texts(texts, block):
    """No pre-token and no special token reaches over the end of a text, wherever blocks end."""
    got = [ids.tobytes() for ids in ENCODER.encode_all(texts, block)]
    assert got == [ENCODER.encode_whole(text) for text in texts]


class _Counted(dict):
    asked = 0

    def get(self, word):
        self.asked += 1
        return super().get(word)

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)


@pytest.mark.parametrize("copies", [1, 500])
def test_words_of_a_block_are_looked_up_once(copies):
    encoder = Encoder(BPE)
    text = "It's one, and one more: 12 of 345.\n\n  Ünd noch einer's _x_ "
    want = encoder.encode_whole(text)
    assert encoder.encode(text) == want
    encoder._known = _Counted(encoder._known)
    assert [ids.tobytes() for ids in encoder.encode_all([text] * copies)] == [want] * copies
    assert encoder._known.asked <= 30


def test_rows_of_a_batch_share_lookups():
    """What op3 and op13 take: each row with its id and end, and no lookup for every occurrence of a word."""
    texts = ["One, and one more.", "", "½ and one", "One<|endoftext|>", "and one more."] * 100
    names = [None if k % 7 == 0 else k % 50 for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    encoder = encoder_of(BPE)
    encoder._known = _Counted(encoder._known)
    got = list(encoded(batch, BPE, 2))
    assert encoder._known.asked <= 20
    assert [doc_id for doc_id, _ in got] == names
    assert [ids.tobytes() for _, ids in got] == [
        encoder.encode_whole(text) + np.array([2], "<u4").tobytes() for text in texts]
