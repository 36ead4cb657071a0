"""Quality rules on repetition, by suffix arrays.

The suffixes of a text's words are sorted by prefix doubling; neighbours in that order and the lengths of their common
prefixes are the bottom of the tree of longest-common-prefix intervals, and an interval's prefix is a maximal repeated
run of words. Each word position's longest repeat is the larger of the common prefixes with its two neighbours, so the
union of all maximal repeats' spans, and the longest, follow from neighbours alone.

Many texts are sorted as one array: words are numbered by text, and a mark that occurs once stands after each text, so
that nothing repeats across texts.

A text fails the base rules with fewer than ``LEAST_WORDS`` words, or where words in 5-word windows that the text has
twice or more make up over ``BASE_SHARE`` of its words. It fails the method's verdict where maximal repeats of
``REPEAT`` words or more cover over ``COVERED`` of its words, or one is over ``LONGEST`` words long.

Defined results: a null text counts as empty, has no words and fails; equal texts and repeated rows get equal answers;
texts of any length are taken whole; an empty table gives no rows; columns with the names of outputs are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewrack.llm.common import SPACE

LEAST_WORDS, BASE_WINDOW, BASE_SHARE = 10, 5, 0.20
REPEAT, COVERED, LONGEST = 10, 0.15, 100
SYMBOLS = "#*$%&|<>"
#: Words sorted at once; a longer text is sorted on its own.
AT_ONCE = 200_000
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def _refined(rank: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as long prefixes, and those of ``at`` that still share theirs. A rank is where its group begins."""
    after = at + step
    second = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], -1)
    order = np.argsort(rank[at] * (len(rank) + 1) + second + 1)
    at, second = at[order], second[order]
    first = rank[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = first[1:] != first[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    split = fresh.copy()
    split[1:] |= second[1:] != second[:-1]
    group = np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))
    rank = rank.copy()
    rank[at] = first + group - begin
    alone = split & np.append(split[1:], True)
    return rank, at[~alone]


def _common(words: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """How many words each two neighbours of ``order`` begin with in common; may be less where it is under ``least``.

    Positions are taken as they stand in the text: what one has in common with its neighbour, less a word, the next has
    with its own, so all words are compared about twice whatever the repeats, and no more than this text is held.
    """
    before = np.full(len(words), -1, np.int64)  # each position's neighbour before
    before[order[1:]] = order[:-1]
    out, spelt, earlier, n = np.zeros(len(words), np.int64), memoryview(words), memoryview(before), len(words)
    held, last = 0, -2
    for p in np.sort(order[1:]).tolist():
        held = held - 1 if p == last + 1 and held > least else 0
        q = earlier[p]
        top = n - max(p, q)
        while held < top and spelt[p + held] == spelt[q + held]:
            held += 1
        out[p] = held
        last = p
    return out[order[1:]]


def longest_repeats(words: np.ndarray, least: int) -> np.ndarray:
    """For each position, the most words from it on that also begin elsewhere; 0 if fewer than ``least``."""
    best = np.zeros(len(words), np.int64)
    kinds, at, n = np.unique(words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n)[at]
    shared, step = np.flatnonzero(n[at] > 1), 1
    kept = None
    while len(shared):
        rank, shared = _refined(rank, shared, step)
        step *= 2
        if step <= least:
            kept = shared  # all whose first ``step`` words occur elsewhere
    if kept is None or not len(kept):
        return best
    order = kept[np.argsort(rank[kept])]  # the suffix array, without those that can't have a repeat of that length
    common = _common(words, order, least)
    common[common < least] = 0
    best[order[:-1]] = common
    best[order[1:]] = np.maximum(best[order[1:]], common)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span that begins at a start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str]) -> dict[str, list[int]]:
    """``FIELDS`` of each text."""
    out: dict[str, list[int]] = {k: [] for k in FIELDS}
    group: list[list[bytes]] = []
    held = 0

    def flush() -> None:
        number: dict = defaultdict(count().__next__)
        ids, ends = [], []
        for k, words in enumerate(group):
            own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            ids += [own << 20 | k, np.array([-1 - k])]
            ends.append(len(words))
        joined = np.concatenate(ids)
        stops = np.cumsum(np.array(ends) + 1)
        begins = stops - 1 - np.array(ends)
        best = longest_repeats(joined, BASE_WINDOW)
        hit = np.flatnonzero(best)
        base = _covered(hit, np.full(len(hit), BASE_WINDOW), len(joined))
        long_ = np.flatnonzero(best >= REPEAT)
        over = _covered(long_, best[long_], len(joined))
        out["n_repeat_words"] += np.add.reduceat(base.astype(np.int64), begins).tolist()
        out["n_covered_words"] += np.add.reduceat(over.astype(np.int64), begins).tolist()
        out["longest_repeat"] += np.maximum.reduceat(best, begins).tolist()

    for text in texts:
        words = text.encode("utf-8", "replace").split()  # on bytes, white space is that of the contract
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACE)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        if group and held + len(words) > AT_ONCE:
            flush()
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        flush()
    return out


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``FIELDS``. One pass over the rows, no shuffle."""
    docs = docs.drop(*FIELDS)
    names = docs.schema.names
    schema = StructType([*docs.schema.fields, *(StructField(f, LongType()) for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = measure([t.as_py() or "" for t in part.column(names.index(text))])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[f], pa.int64()) for f in FIELDS)], names=[*names, *FIELDS])

    return docs.mapInArrow(run, schema)


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, and what the verdict rests on."""
    found = repetition(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * BASE_SHARE) * F.col("n_words"))
    fair = (F.col("n_covered_words") <= COVERED * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & fair).alias("kept"), "n_covered_words", "longest_repeat",
    )
