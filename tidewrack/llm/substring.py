"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text; where its low ``WINDOW`` bits fall below a bound, a chunk ends. The low
bits depend on the last ``WINDOW`` bytes alone, so equal passages are cut at equal places whatever stands before them,
and an insertion shifts no cut beyond the next. Chunks are ``AVERAGE`` bytes long or so, ``LEAST`` at least and
``MOST`` at most, and end between characters.

White space is one blank to the chunker, so that a passage is the same however its lines are broken.

Chunks are grouped by digest. A digest that occurs in two documents or more is shared; shared chunks that follow each
other in a document are one run, and runs of ``PASSAGE`` characters or more are repeated passages. The document with
the smallest id of those that have a chunk keeps it; the others' are to be removed. Repeats within one document are
not this operator's business.

``PASSAGE`` is about 16 words, a third of the 50-word passages looked for, since a run ends at the last cut inside
the passage. The digest has 64 bits; a run needs several chunks in a row, so chance matches make no passage.

Two passes read the texts: one groups digests (combined before the shuffle, and a digest carries three numbers, not
its chunks), the other joins the chunks with the shared digests, which Spark may split where a chunk is very common.

Defined results: a null or empty text has no chunk; rows without an id are left out, since their passages couldn't
be told apart; rows that repeat an id count as one document, each different text of it with passages of its own and
equal texts with one answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import cut

WINDOW, AVERAGE, LEAST, MOST = 16, 22, 6, 256
PASSAGE = 100
#: Rows that go back to Spark at once, about.
OUT_ROWS = 100_000
#: Bits of a text's hash that tell rows of one id apart.
LOW = (1 << 31) - 1
#: The gear table: one random number for each byte, from a fixed seed.
GEAR = np.random.default_rng(1618).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(raw: bytes) -> list[int]:
    """Ends of the text's chunks."""
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data)
    hashed = GEAR[data]  # of one byte; then of 2, 4, 8 and 16, each from the half before
    for step in (1, 2, 4, 8):
        more = hashed.copy()
        more[step:] += hashed[:-step] << np.uint16(step) if n > step else 0
        hashed = more
    whole = np.ones(n + 1, bool)
    whole[:-1] = (data & 0xC0) != 0x80
    ends = (np.flatnonzero((hashed < (1 << WINDOW) // AVERAGE) & whole[1:]) + 1).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > MOST:
            forced = last + MOST
            while not whole[forced]:
                forced -= 1
            out.append(forced)
            last = forced
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def reflowed(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The text with each run of white space as one blank, and the code point at which each of its bytes stood (and the
    end's), so that passages are equal however their lines are broken."""
    data = np.frombuffer(raw, np.uint8)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    space = (data == 32) | (data >= 9) & (data <= 13)
    kept = np.flatnonzero(~(space[1:] & space[:-1])) + 1
    kept = np.concatenate(([0], kept))
    plain = np.where(space, np.uint8(32), data)[kept]
    first = (plain & 0xC0) != 0x80
    return plain.tobytes(), np.append(points[kept] - ~first, points[-1])


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, digest, start, end) of each chunk, in code points, end exclusive; row is a hash of the text (``_row``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in held], names=["doc_id", "row", "digest", "start", "end"])

        held: tuple[list, ...] = ([], [], [], [], [])
        n = 0
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                if not raw:
                    continue
                row = xxhash.xxh64_intdigest(raw, 42) & LOW
                plain, at = reflowed(raw)
                ends = cuts(plain)
                begins = [0, *ends[:-1]]
                digest = np.fromiter((xxhash.xxh3_64_intdigest(plain[a:b]) for a, b in zip(begins, ends)), np.uint64, len(ends))
                for x, y in zip(held, (np.full(len(ends), own, np.int64), np.full(len(ends), row, np.int64), digest.view(np.int64), at[begins], at[ends]), strict=True):
                    x.append(y)
                n += len(ends)
                if n >= OUT_ROWS:
                    yield rows()
                    held, n = ([], [], [], [], []), 0
        if n:
            yield rows()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, row long, digest long, start long, end long")


def _row(text: str = "text") -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(LOW))


def shared(dealt: DataFrame) -> DataFrame:
    """(digest, first_id, last_id) of the digests that several documents have."""
    ends = dealt.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return ends.where(F.col("first_id") < F.col("last_id"))


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """A row for each repeated passage of each document: doc_id, start, end, n_chunks, first_id (of the earliest document
    that has one of its chunks), removed_chars (in chunks that a document with a smaller id keeps), row (hash of its text)
    and gone (the spans of those chunks)."""
    dealt = chunks(docs)
    hit = dealt.join(cut(shared(dealt)), "digest").select("doc_id", "row", "start", "end", "first_id")
    in_text = Window.partitionBy("doc_id", "row").orderBy("start")
    # chunks of a text don't overlap, so that equal starts are a repeated row's
    again = F.lag("start").over(in_text) == F.col("start")
    hit = hit.withColumn("again", F.coalesce(again, F.lit(False))).where(~F.col("again"))
    fresh = F.when(F.lag("end").over(in_text) == F.col("start"), 0).otherwise(1)
    runs = hit.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.col("first_id") < F.col("doc_id")
    gone = F.when(earlier, F.col("end") - F.col("start")).otherwise(0)
    spans = F.sort_array(F.collect_list(F.when(earlier, F.struct("start", "end"))))
    found = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("first_id").alias("first_id"), F.sum(gone).alias("removed_chars"), spans.alias("gone"))
    return found.where(F.col("end") - F.col("start") >= passage).drop("run")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the chunks of passages that earlier documents keep cut out of their texts.

    A document's passages meet in one row with its text; there are at most as many as the text has room for.
    """
    spans = passages.where("removed_chars > 0").groupBy(F.col("doc_id").alias("named"), F.col("row").alias("of")).agg(F.sort_array(F.flatten(F.collect_list("gone"))).alias("spans"))
    both = docs.join(spans, (F.col("doc_id") == F.col("named")) & (_row() == F.col("of")), "left")
    step = lambda s, x: F.struct(F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("text"), x["end"].alias("at"))
    told = F.aggregate("spans", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), step)
    rest = F.concat(told["text"], F.substring(F.col("text"), (told["at"] + 1).cast("int"), F.length("text")))
    return both.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
