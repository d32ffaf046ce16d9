"""Token counts under a unigram piece model, by dynamic programming over a trie.

The distinct pre-tokens of an Arrow batch form a trie, walked in sorted order:
the path of the last pre-token is kept, and only what lies below the shared
prefix is computed anew. A node holds the best score of any split of its prefix
into pieces and the number of pieces of that split; the numbers at the ends of
pre-tokens are the terminal counts, kept for later batches of the task (at most
``MEMORY`` characters of pre-tokens, ``OVERHEAD`` added for each). A document's count is the sum over its pre-tokens.

A pre-token is a run of characters that are not white space, with the word mark
before it. Piece scores are the logarithm of a Zipf law over the rank in the
vocabulary; a character outside it costs one token per UTF-8 byte. Of splits
with equal scores the one of fewer tokens counts.

Defined results: null and empty texts have no tokens; repeated rows are counted
each for itself; a null id stays null; an empty table gives no rows; columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import text_or_empty

MARK = "▁"
MEMORY = 50_000_000
OVERHEAD = 100
SCHEMA = "doc_id bigint, n_chars bigint, n_pretokens bigint, n_tokens bigint"


def load_pieces(model_path: str) -> dict[str, float]:
    """Piece and score of a SentencePiece vocabulary, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kept = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return {p: -math.log(rank + 2) for rank, p in enumerate(kept)}


class PieceTrie:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_cost = -math.log(len(pieces) + 2) - 1.0

    def terminal_counts(self, words: Iterable[str]) -> dict[str, int]:
        """Token count of each word; shared prefixes are scored once."""
        pieces, longest, found = self.pieces, self.longest, {}
        path, best, count = MARK, [0.0, 0.0], [0, 0]
        best[1], count[1] = self._step(MARK, 1, [0.0], [0])
        for word in sorted(words):
            marked = MARK + word
            shared, end = 0, min(len(path), len(marked))
            if marked.startswith(path):
                shared = len(path)
            else:
                while shared < end and path[shared] == marked[shared]:
                    shared += 1
            del best[shared + 1:], count[shared + 1:]
            for at in range(shared + 1, len(marked) + 1):
                score, tokens = self._fallback(marked[at - 1], best[at - 1], count[at - 1])
                for start in range(max(0, at - longest), at):
                    worth = pieces.get(marked[start:at])
                    if worth is not None:
                        worth += best[start]
                        if worth > score or worth == score and count[start] + 1 < tokens:
                            score, tokens = worth, count[start] + 1
                best.append(score)
                count.append(tokens)
            path = marked
            found[word] = count[-1]
        return found

    def _fallback(self, char: str, score: float, tokens: int) -> tuple[float, int]:
        size = len(char.encode())
        return score + self.byte_cost * size, tokens + size

    def _step(self, text: str, at: int, best: list, count: list) -> tuple[float, int]:
        score, tokens = self._fallback(text[at - 1], best[at - 1], count[at - 1])
        worth = self.pieces.get(text[:at])
        return (worth, 1) if worth is not None and worth >= score else (score, tokens)


def count_tokens(docs: DataFrame, model_path: str, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens; ``model_path`` must exist on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known, held = PieceTrie(load_pieces(model_path)), {}, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = [t.split() for t in texts]
            new = set().union(*map(set, split)) - known.keys() if split else set()
            more = sum(map(len, new)) + OVERHEAD * len(new)
            if held + more > memory and known:
                known, new = {}, set().union(*map(set, split))
                held, more = 0, sum(map(len, new)) + OVERHEAD * len(new)
            held += more
            known.update(trie.terminal_counts(new))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, split), pa.int64()),
                 pa.array([sum(map(known.__getitem__, words)) for words in split], pa.int64())],
                names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
