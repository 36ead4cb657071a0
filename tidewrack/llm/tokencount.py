"""Token counts by dynamic programming on a trie.

Texts are counted under a unigram model: a pre-token (a word with the word mark before it) is cut into the pieces of
a public vocabulary whose log probabilities have the largest sum. The best score of a prefix doesn't depend on what
follows it. So the distinct pre-tokens go into a trie, the forward score of each node is computed once, whichever
pre-tokens share it, and the count at a pre-token's last node is kept for its next occurrence.

The vocabulary has ranks and no probabilities; a piece's log probability is taken by Zipf's law, -ln(1 + rank), in
millionths as an integer, so that equal sums are equal. Among equal sums the fewest tokens count. A character that no
piece has stands as its UTF-8 bytes, one token for each, at the cost of the rarest piece and ``BYTE_COST`` more.

Tries stay in their worker: what all documents share is one vocabulary, not a table of words, and no row is shuffled.
A trie over ``NODES`` nodes is dropped and begun anew, which bounds memory and changes no count.

Defined results: a null text counts as empty and has no tokens; equal texts and repeated rows get equal counts; texts
of any length are counted whole; an empty table gives no rows; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

MARK = "▁"
UNIT = 1_000_000
BYTE_COST = 10 * UNIT
NODES = 400_000
FIELDS = ("n_words", "n_tokens")


def read_pieces(path: str) -> dict[str, int]:
    """Score of each ordinary piece of a sentencepiece model; bytes and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -round(UNIT * math.log(1 + rank)) for rank, i in enumerate(ids)}


class Trie:
    """Forward scores of all prefixes seen. Node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0) - BYTE_COST
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}
        self.score = [0]
        self.tokens = [0]
        self.counts: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of the pre-token; new nodes get their score from those above them."""
        path, node = [0], 0
        below, score, tokens, pieces = self.below, self.score, self.tokens, self.pieces
        for end, char in enumerate(word, 1):
            key = node << 21 | ord(char)
            node = below.get(key, 0)
            if not node:
                n = len(char.encode("utf-8", "replace"))
                before = path[-1]
                best, fewest = score[before] + n * self.byte, tokens[before] + n
                for begin in range(max(0, end - self.longest), end):
                    own = pieces.get(word[begin:end])
                    if own is not None:
                        sum_, number = score[path[begin]] + own, tokens[path[begin]] + 1
                        if sum_ > best or sum_ == best and number < fewest:
                            best, fewest = sum_, number
                below[key] = node = len(score)
                score.append(best)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = text.encode("utf-8", "replace").split()  # on bytes, white space is blank, \\t, \\n, \\v, \\f and \\r
        counts = self.counts
        if len(self.score) > NODES:
            self.clear()
            counts = self.counts
        for word in set(words).difference(counts):
            counts[word] = self.insert(MARK + word.decode())
        return len(words), sum(map(counts.__getitem__, words))


@lru_cache(maxsize=1)
def _trie(key: str, pieces: tuple[tuple[str, int], ...]) -> Trie:
    return Trie(dict(pieces))


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens. One pass over the rows; the vocabulary, read on the driver, is of fixed size."""
    pieces = tuple(read_pieces(model_path).items())
    docs = docs.drop(*FIELDS)
    names = docs.schema.names
    schema = StructType([*docs.schema.fields, *(StructField(f, LongType()) for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_path, pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = [trie.count(t.as_py() or "") for t in part.column(names.index(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in range(2))], names=[*names, *FIELDS])

    return docs.mapInArrow(run, schema)
