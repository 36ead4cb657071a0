"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes long is learned and frozen. The code length of a byte
is that of its symbol in the longest context known, or that context's escape and then the next shorter context's code,
down to 8 bits for a byte never seen (escape method C: a context with total T and q distinct symbols gives each symbol
its count / (T + q) and the escape q / (T + q)). A text's language is that whose tree codes it in the fewest bits.

As statistics are frozen, the code length of a byte depends on its last ``ORDER`` bytes and itself alone: trees are
tables of windows, and texts are scored by array look-ups.

Texts are lower-cased and each run of other characters than letters becomes one blank, in learning and in prediction.

Bounds: of the ``LANGUAGES`` languages with most rows, at most about ``rows`` labelled rows of each, chosen by a hash
of the id, are learned from, where they lie, since that table of languages is small enough to broadcast; of their windows the ``windows`` most frequent of each language are kept. The model so has a size of its own, which does
not grow with the input. Prediction reads every text whole.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where nothing could be learned; rows
whose text or language is null are not learned from; ties go to the language first by code point; repeated rows get
equal answers; an empty table gives no rows; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Bytes of the longest context; windows of one byte more fill an unsigned 32-bit integer.
ORDER = 3
#: Languages learned at most, labelled rows of each to learn from, and distinct windows of each kept.
LANGUAGES, ROWS, WINDOWS = 1000, 4000, 200_000
#: Bytes scored at once, and bytes of evidence that the score counts at most.
AT_ONCE, EVIDENCE = 1 << 20, 64
UNKNOWN = "und"
START = b"\1"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text as it is learned and scored; empty if it has no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return plain.encode("utf-8", "replace") if any(map(str.isalpha, plain)) else b""


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Windows of about ``AT_ONCE`` bytes of the texts: the texts' numbers, their first windows, and all windows.

    A text begins in a context of bytes that no text has; a long one is cut with its context repeated.
    """
    own: list[int] = []
    parts: list[bytes] = []
    held = 0

    def ready():
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        lengths = np.array([len(p) for p in parts])
        at = raw.astype(np.uint32)
        windows = at[:-3] << 24 | at[1:-2] << 16 | at[2:-1] << 8 | at[3:]
        use = np.ones(len(raw), bool)
        begins = np.cumsum(lengths) - lengths
        for k in range(ORDER):
            use[begins + k] = False
        return list(own), np.cumsum(lengths - ORDER) - (lengths - ORDER), windows[use[ORDER:]]

    for n, text in enumerate(texts):
        padded = START * ORDER + text
        for k in range(0, len(text), AT_ONCE):
            own.append(n)
            parts.append(padded[k : k + AT_ONCE + ORDER])
            held += len(parts[-1])
            if held >= AT_ONCE:
                yield ready()
                own, parts, held = [], [], 0
    if parts:
        yield ready()


class Table:
    """Where each of a set of distinct non-zero unsigned 32-bit keys stands in it: an open-addressed hash table."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(max(4, 32 - max(4, int(2 * len(keys)).bit_length())))
        self.keys = np.zeros((1 << (32 - int(self.shift))), np.uint32)
        self.places = np.full(len(self.keys), -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.places[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.places[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return found


@dataclass
class Model:
    """Code lengths in bits, one column for each language, for windows of 4, 3 and 2 bytes, and escapes of contexts."""

    languages: list[str]
    four: Table
    bits4: np.ndarray
    three: Table
    bits3: np.ndarray
    context: Table
    escape3: np.ndarray
    escape2: np.ndarray
    bits2: np.ndarray

    def _three(self, windows: np.ndarray) -> np.ndarray:
        at = self.three.find(windows)
        bits = self.bits3[at]
        miss = np.flatnonzero(at < 0)
        bits[miss] = self.escape2[windows[miss] >> 8] + self.bits2[windows[miss] & 0xFFFF]
        return bits

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """The code length of each window's last byte, by language."""
        at = self.four.find(windows)
        bits = self.bits4[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            context = self.context.find(windows[miss] >> 8)
            bits[miss] = np.where(context[:, None] >= 0, self.escape3[context], np.float32(0)) + self._three(windows[miss] & 0xFFFFFF)
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text by language."""
        total = np.zeros((len(texts), len(self.languages)))
        for own, begins, windows in _pieces(texts):
            np.add.at(total, own, np.add.reduceat(self.bits(windows), begins, axis=0, dtype=np.float64))
        return total


def _by(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys))


def build(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The frozen trees from each language's windows of four bytes and their counts."""
    languages = sorted(counted)
    orders = {k: [_by(counted[x][0] & np.uint32((1 << 8 * (k + 1)) - 1), counted[x][1]) for x in languages] for k in range(ORDER + 1)}
    unions = {k: np.unique(np.concatenate([codes for codes, _ in orders[k]])) for k in (2, 3)}
    contexts3 = np.unique(unions[3] >> 8)
    shape = lambda n: np.zeros((n, len(languages)), np.float32)
    model = Model(languages, Table(unions[3]), shape(len(unions[3])), Table(unions[2]), shape(len(unions[2])), Table(contexts3), shape(len(contexts3)), shape(1 << 16), shape(1 << 16))
    for j in range(len(languages)):
        symbol = np.full(256, 8.0)
        lower, escapes = symbol, None
        for k in range(ORDER + 1):
            codes, counts = orders[k][j]
            contexts, total = _by(codes >> 8, counts)
            kinds = np.bincount(np.searchsorted(contexts, codes >> 8))
            bits = -np.log2(counts / (total + kinds)[np.searchsorted(contexts, codes >> 8)])
            escape = -np.log2(kinds / (total + kinds))
            if k < 2:
                all_codes = np.arange(1 << 8 * (k + 1))
                escapes = np.zeros(1 << 8 * k)
                escapes[contexts] = escape
                lower = escapes[all_codes >> 8] + lower[all_codes & ((1 << 8 * k) - 1 if k else 0xFF)]
                lower[codes] = bits
                if k == 1:
                    model.bits2[:, j] = lower
            elif k == 2:
                model.escape2[contexts, j] = escape
                here = model.escape2[unions[2] >> 8, j] + model.bits2[unions[2] & 0xFFFF, j]
                here[np.searchsorted(unions[2], codes)] = bits
                model.bits3[:, j] = here
            else:
                model.escape3[np.searchsorted(contexts3, contexts), j] = escape
                here = model.escape3[np.searchsorted(contexts3, unions[3] >> 8), j] + model._three(unions[3] & 0xFFFFFF)[:, j]
                here[np.searchsorted(unions[3], codes)] = bits
                model.bits4[:, j] = here
    return model


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = ROWS, windows: int = WINDOWS) -> Model | None:
    """Frozen trees of all languages that ``docs`` name; None if there are none.

    A count by language, then one pass over the chosen rows; window counts are combined before the shuffle.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    share = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang", (F.lit(float(rows)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = named.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(language, []).append(letters(t.as_py()))
            for language, texts in by.items():
                for _, _, codes in _pieces(texts):
                    keys, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    kept = counted.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("nth") <= windows)
    found = kept.select("lang", "code", "n").toPandas()
    by_language = {language: (own["code"].to_numpy().astype(np.uint32), own["n"].to_numpy()) for language, own in found.groupby("lang")}
    return build(by_language) if by_language else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if so asked) with lang_pred, score (0 to 1) and bits_per_byte (of the best language; null for ``und``).

    The score is the language's share of the likelihood, the evidence of all bytes counted as that of ``EVIDENCE``
    bytes at most. One pass over the rows, no shuffle.
    """
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    kept = [n for n in docs.columns if keep_text or n != text]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    names = docs.schema.names
    schema = StructType([*(docs.schema[n] for n in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = [letters(t.as_py()) for t in batch.column(names.index(text))]
        size = np.array([len(t) for t in plain])
        bits = model.code_lengths(plain)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        share = 1 / np.exp2(-(bits - least[:, None]) * (np.minimum(size, EVIDENCE) / np.maximum(size, 1))[:, None]).sum(axis=1)
        found = [model.languages[k] if m else UNKNOWN for k, m in zip(best, size)]
        rate = pa.array(least / np.maximum(size, 1), mask=size == 0)
        return pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(found, pa.string()), pa.array(np.where(size > 0, share, 0.0)), rate], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                yield answer(batch.slice(k, 1000))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether the id's CRC-32 leaves 2 on division by 4; not so for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the others than those held out."""
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that the trees, learned from ``docs``' own labels, code better than raw bytes; ``und`` goes."""
    found = predict(docs, learn(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < 8)).select(*docs.columns)
