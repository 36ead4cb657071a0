"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

No tokenizer is trained: each rank of the vocabulary becomes one piece whose bytes are mapped to visible
characters and whose score is the negative rank, so that sentencepiece's "best score, then leftmost" merge
order is the vocabulary's own merge order. Normalisation is the identity.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole; repeated rows are
encoded alike; extra columns of the input pass through ``encode`` untouched unless they have the name of an output
column, in which case the output column replaces them.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Rows and bytes that go back to Spark at once.
OUT_ROWS, OUT_BYTES = 512, 8 << 20
#: Distinct pre-tokens that a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 600_000
#: Stands for a piece outside the vocabulary; no mapped byte has this character.
UNKNOWN = "⁇"


def byte_characters() -> list[str]:
    """One visible character for each byte: itself where it prints in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in rank order; the file holds base64 and rank on each line."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f)]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [piece for _, piece in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited, varint or 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is the byte-mapped string of rank i and has score -i.

    The model needs one unknown piece; it comes last, so that ids are ranks.
    """
    shown = byte_characters()
    pieces = [("".join(shown[b] for b in piece), float(-rank), 1) for rank, piece in enumerate(vocabulary)]
    pieces.append((UNKNOWN, 0.0, 2))  # type 1 normal, 2 unknown
    body = b"".join(_field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind)) for text, score, kind in pieces)
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(vocabulary)) + b"".join(_varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes single texts with a model from ``serialise_model``."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.shown = byte_characters()
        back = {c: b for b, c in enumerate(self.shown)}
        n = self.pieces.get_piece_size() - 1
        self.bytes_of = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(n)]
        self.latin = {i: c for i, c in enumerate(self.shown)}
        #: A pre-token that is a vocabulary entry has that id, even if no chain of merges leads to it.
        self.whole = {piece: struct.pack("<I", i) for i, piece in enumerate(self.bytes_of)}
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        rest = []
        for token in tokens:
            raw = token.encode("utf-8", "replace")
            if raw in self.whole:
                self.known[token] = self.whole[raw]
            else:
                rest.append((token, raw.decode("latin-1").translate(self.latin)))
        for (token, _), ids in zip(rest, self.pieces.encode([text for _, text in rest], num_threads=1) if rest else []):
            self.known[token] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        new = set(tokens).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(tokens)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for: pieces are looked up and their characters mapped back."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary, from the ids).

    One pass over the rows, no shuffle. The model is about 1 MB whatever the input and travels with the function.
    """
    model = serialise_model(read_ranks(vocabulary_path))
    docs = docs.drop("token_ids", "decoded")
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pattern)
        for batch in batches:
            texts, start, ids, back, held = batch.column(fields.index(text)), 0, [], [], 0
            for at in range(batch.num_rows):
                coded = codec.encode(texts[at].as_py() or "")
                ids.append(coded)
                back.append(codec.decode(coded))
                held += len(coded) + len(back[-1])
                if len(ids) >= OUT_ROWS or held >= OUT_BYTES or at + 1 == batch.num_rows:
                    rows = batch.slice(start, len(ids))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[*fields, "token_ids", "decoded"])
                    start, ids, back, held = at + 1, [], [], 0

    schema = StructType([*docs.schema.fields, StructField("token_ids", BinaryType()), StructField("decoded", BinaryType())])
    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs.select("doc_id", "text"), vocabulary_path, pattern).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
