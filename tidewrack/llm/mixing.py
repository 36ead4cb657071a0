"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate, the number of copies the mix should take of it. Of all rates that meet every source's word
target and stay under the cap, those wanted have the least relative entropy against one base rate for all documents:

    rate = min(cap, base * exp(lambda(source) * size / mean size of the source))

The multipliers solve the convex dual. Sources share no documents, so the dual's Hessian is diagonal, and a Newton step
for all sources at once is one distributed aggregate: words at the present rates and their derivative. Steps are taken
on the logarithm of the words and kept inside a bracket, halving it where a step leaves it.

Rates depend on source and size alone, so each iteration reads a table of distinct (source, size) and not documents.

Rounding into whole copies: the running sum of rates over a source's sizes is rounded, so that each size gets a whole
number of copies; then copies are added or removed, largest sizes first, until the source is as near to its target as
its sizes allow or ``REPAIRS`` rounds are over. The copies of a size are dealt evenly to its documents, which are
ranked in hash buckets, so that no task gets all documents of a source or of a size.

Defined results: a null text has size 0; sources are ordered by code point with null last, as a source of its own; a
document of size 0 takes no words; a source without words has target 0; equal sizes are told apart by the hash of the
id, then the id, and rows that repeat both by chance alone, which moves no total; a null id hashes like any value; a
source of which one document is the larger part comes as near to its target as whole copies allow; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of the documents of one source and size.
BUCKETS = 64
#: Newton steps at most, the relative error at which they end, and how often the steps look at it.
STEPS, ENOUGH, LOOK = 60, 1e-10, 4
#: Rounds that bring a source's words nearer to its target after the rounding.
REPAIRS = 6


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size): words of each document; and the columns ``also``."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.cast("long").alias("size"), *also)


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each source; the windows run over sources, not documents.

    Sources share ``share`` of all words by weight; a target stops at ``cap`` times its source's words and the excess
    goes to the others by weight until none is above. Sources stop in order of words per weight, so one sorted pass
    finds the level: the first source that needn't stop when all before it have.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*(F.lit(float(w)) for w in weights))
    weighed = total.withColumn("weight", F.element_at(ring, F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))).cast("int") + 1))
    weighed = weighed.withColumn("most", cap * F.col("source_size"))
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", F.try_divide(left, weight))
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, 0))
    return levelled.withColumn("stop", level).select("source", "source_size", F.coalesce(F.col("stop") * F.col("weight"), F.col("most")).alias("target"))


def rates(cells: DataFrame, wanted: DataFrame, base: float, cap: float) -> DataFrame:
    """``cells`` (source, size, n) with the entropy-balanced rate of each."""
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    words = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))
    state = wanted.alias("s").join(words.alias("c"), same).select(
        "s.source", "s.target", (F.col("words") / F.col("n")).alias("mean"), F.lit(0.0).alias("tilt"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("error"),
    )
    state = cut(state.where((F.col("target") > 0) & (F.col("target") < cap * F.col("words") * (1 - 1e-12))))
    tilted = base * F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
    part = F.col("size") * F.col("n")
    for step in range(1, STEPS + 1):
        both = cells.alias("c").join(state.alias("s"), same).select("s.*", "size", "n", tilted.alias("rate"))
        held = F.col("rate") >= cap
        summed = both.groupBy("source", "target", "mean", "tilt", "low", "high").agg(
            F.sum(part * F.least("rate", F.lit(cap))).alias("g"),
            F.sum(F.when(held, 0.0).otherwise(part * F.col("rate") * F.col("size") / F.col("mean"))).alias("slope"),
        )
        above = F.col("g") > F.col("target")
        moved = summed.select(
            "*", F.when(above, F.col("tilt")).otherwise(F.col("high")).alias("top"), F.when(above, F.col("low")).otherwise(F.col("tilt")).alias("bottom"),
            (F.col("tilt") + F.try_divide(F.ln(F.col("target") / F.col("g")) * F.col("g"), F.col("slope"))).alias("newton"),
        )
        inside = (F.col("newton") > F.coalesce("bottom", F.lit(-1e6))) & (F.col("newton") < F.coalesce("top", F.lit(1e6)))
        half = F.coalesce((F.col("top") + F.col("bottom")) / 2, F.when(F.col("top").isNull(), 2 * F.abs("bottom") + 1), -2 * F.abs("top") - 1)
        error = F.abs(F.col("g") / F.col("target") - 1)
        step_to = F.when(error < ENOUGH, F.col("tilt")).when(inside, F.col("newton")).otherwise(half)
        state = cut(moved.select("source", "target", "mean", step_to.alias("tilt"), F.col("bottom").alias("low"), F.col("top").alias("high"), error.alias("error")))
        if step % LOOK == 0 and (state.agg(F.max("error")).first()[0] or 0) < ENOUGH:
            break
    solved = cells.alias("c").join(state.alias("s"), same, "left").select("c.*", F.least(tilted, F.lit(cap)).alias("rate"))
    full = wanted.alias("s").select(F.col("s.source").alias("named"), "target")
    rate = F.coalesce("rate", F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0)))
    return solved.alias("c").join(full, F.col("c.source").eqNullSafe(F.col("named"))).select("source", "size", "n", rate.alias("rate"))


def rounded(rated: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """``rated`` with ``copies``, the whole number that the documents of each (source, size) take together.

    The running sum of rates by size is rounded; then copies are added or removed, in the largest sizes that fit what
    a source still lacks or has too many of, until nothing fits. All windows run over the sizes of a source.
    """
    source = Window.partitionBy("source")
    upto = source.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    larger = source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    named = wanted.select(F.col("source").alias("named"), "target")
    told = rated.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    told = told.withColumn("sum", F.sum(F.col("n") * F.col("rate")).over(upto))
    copies = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("n") * F.col("rate") + 0.5)
    told = told.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), cap * F.col("n")).cast("long"))
    for _ in range(REPAIRS):
        told = told.withColumn("lack", F.col("target") - F.sum(F.col("size") * F.col("copies")).over(source))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack"))
        told = told.withColumn("room", F.when(fits, F.when(F.col("lack") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))).otherwise(0))
        left = F.abs("lack") - F.coalesce(F.sum(F.col("size") * F.col("room")).over(larger), F.lit(0))
        take = F.least(F.greatest(F.floor(F.try_divide(left, F.col("size"))), F.lit(0)), F.col("room"))
        told = told.withColumn("copies", (F.col("copies") + F.signum("lack") * F.coalesce(take, F.lit(0))).cast("long"))
    return told.select("source", "size", "n", "copies")


def _dealt(sized: DataFrame, cells: DataFrame, whole: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The copies of each (source, size) dealt evenly to its documents, in the order of buckets, then hashes and ids."""
    cell = ["source", "size"]
    by_bucket = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = cells.withColumn("ahead", F.sum("m").over(by_bucket) - F.col("m"))
    same = F.col("b.source").eqNullSafe(F.col("r.source")) & (F.col("b.size") == F.col("r.size"))
    placed = buckets.alias("b").join(whole.alias("r"), same).select("b.source", "b.size", "bucket", "ahead", "n", "copies")
    ranked = sized.withColumn("nth", F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("hash", "doc_id", *also)))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.bucket") == F.col("p.bucket"))
    own = F.expr("(ahead + nth) * copies div n") - F.expr("(ahead + nth - 1) * copies div n")
    return ranked.alias("d").join(placed.alias("p"), on).select("doc_id", "d.source", "d.size", own.alias("copies"), *also)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, also: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; and the columns ``also``, which tell rows
    of one id apart."""
    sized = sizes(docs, also=also).withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.col("hash"), F.lit(BUCKETS)))
    sized = cut(sized)
    cells = cut(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("m")))
    by_size = cut(cells.groupBy("source", "size").agg(F.sum("m").alias("n")))
    wanted = cut(targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap))
    whole = cut(rounded(rates(by_size, wanted, share, float(cap)), wanted, cap))
    copied = _dealt(sized, cells, whole, also)
    return copied.alias("c").join(wanted.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source"))).select("doc_id", "c.source", "size", "source_size", "target", "copies", *also)


def taken(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
