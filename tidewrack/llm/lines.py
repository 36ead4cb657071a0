"""Fuzzy line dedup, with DataFrame and SQL functions only.

Lines are normalised (lower case, each run of other characters than letters and digits a blank). The fingerprint of a
line is a SimHash in ``BLOCKS`` blocks of 64 bits. Every block draws ``DRAWS`` words of the line by hashes of its own,
long words more likely than short ones, and its bits are those set in over half of the hashes of the drawn words. A
small change so alters the blocks that drew a changed word and no others, whereas in a SimHash of all words it alters
some bits of every block. Lines that agree on a block are candidates (pigeonhole: they differ too little to alter all
blocks), and are linked if their edit similarity, 1 - distance / longer length, is at least ``similarity``. Of each
connected group one occurrence stays, the one with the smallest doc_id, then line number.

Where changed words make up a fifth of a line's characters, two lines share about two thirds of what is drawn, hence a
block with probability 0.3, and one of the eight with 0.94; nearer lines meet more surely. Changes strewn over most of
a line's words alter all blocks, and such pairs are missed, although the edit similarity may allow them.

Candidates are compared if they share ``ALIKE`` of all draws and their lengths allow the similarity. An upper bound of the
edit distance, taken piece by piece, settles most similar pairs; of the others the distance itself is taken, so that no
bound decides that two lines are unlike. Large tables between the steps are written compressed into the shared folder,
and a step's shuffle files go when its table is written.

Not all pairs of a block's lines are compared. First each line is compared with the block's first line only; those
that prove similar make groups. Then come lines that share a block and whose groups still differ, at least one of them
outside the group of the block's first line: of the pairs between two groups the one that shares the most draws, and
then all others whose groups are still apart. So a template of n variants costs about n comparisons, and no link between
different groups is lost.

Defined results: a null text counts as empty and has one empty line; lines of fewer than ``WORDS`` words (whole lines
of scripts without blanks too) are matched when equal alone; lines without words are left alone; lines that repeat in
one document are repeats like others; rows that repeat an id share its line numbers, and their equal lines stay or go
together; null ids come before others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import stored
from tidewrack.llm.components import connected_components

SIMILARITY, WORDS = 0.8, 5
BLOCKS, DRAWS = 8, 3
#: Draws of the 24 that two lines must share to be compared, and longs that hold eight bits of each draw.
ALIKE, SKETCH = 12, ["s0", "s1", "s2"]
#: Characters between the places of a line that are looked up in the other, how many are looked up there, and how far
#: from where they are expected at least.
STEP, ANCHOR, AROUND = 24, 12, 8
#: Characters of a piece beyond which its distance is not taken by itself (a quarter of the line's if that is more), and of
#: a line beyond which what both begin and end with is taken off first.
LARGE = 2000
#: The lowest bit of each of eight bytes.
ONES = 0x0101010101010101


def raw_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, raw) of every line."""
    split = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "raw"))
    return split.withColumn("line_no", F.col("line_no").cast("long"))


def normalised(lines: DataFrame) -> DataFrame:
    """``lines`` with line, n_words, k1 and k2 (128 bits of hash of the line) in place of raw; lines without words are left out."""
    words = F.array_remove(F.split(F.lower("raw"), r"[^\p{L}\p{N}]+"), "")
    # exploded, so that what follows reads the words and doesn't make them once more
    told = lines.select(*(c for c in lines.columns if c != "raw"), F.explode(F.array(words)).alias("words")).where(F.size("words") > 0)
    told = told.withColumn("line", F.array_join("words", " ")).withColumn("n_words", F.size("words")).drop("words")
    return told.select("*", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"))


def _draws(words: DataFrame) -> DataFrame:
    """(k1, short, long, d0_0, d0_1 ...): the word that each draw takes, as one number. Words are dealt to a block's draws
    by hash, and of those of a draw the one with the least hash for its length is taken."""
    hashed = words.select("k1", "size", "chars", *(F.xxhash64("h", F.lit(k)).alias(f"h{k}") for k in range(BLOCKS)))
    high = [f"shiftrightunsigned(h{k}, 34)" for k in range(BLOCKS)]
    low = lambda k: F.col(f"h{k}").bitwiseAND(F.lit((1 << 32) - 1))
    ones = [F.shiftleft(F.expr(f"{high[k]} div chars"), 32).bitwiseOR(low(k)).alias(f"one{k}") for k in range(BLOCKS)]
    dealt = hashed.select("k1", "size", *ones, *(F.expr(f"cast({high[k]} as int) % {DRAWS}").alias(f"j{k}") for k in range(BLOCKS)))
    none = F.lit((1 << 63) - 1)  # over all numbers of words; minima without nulls take half the time
    least = lambda k, j: F.nullif(F.min(F.when(F.col(f"j{k}") == j, F.col(f"one{k}")).otherwise(none)), none)
    draws = [least(k, j).alias(f"d{k}_{j}") for k in range(BLOCKS) for j in range(DRAWS)]
    return dealt.groupBy("k1").agg(F.min("size").alias("short"), F.max("size").alias("long"), *draws)


def _majority(votes: list[Column]) -> Column:
    """The bits set in over half of three numbers; of two or one where the others are null."""
    a, b, c = votes
    both = [a.bitwiseAND(b), a.bitwiseAND(c), b.bitwiseAND(c)]
    return F.coalesce(both[0].bitwiseOR(both[1]).bitwiseOR(both[2]), *both, a, b, c)


def fingerprints(lines: DataFrame) -> DataFrame:
    """(k1, short, long, fp, s0, s1, s2) of each distinct line: its characters (least and most of the lines that share the
    hash, as a rule one line), its blocks, and eight bits of each draw. Equal lines are one row from here on."""
    words = lines.select("k1", F.length("line").alias("size"), F.explode(F.split("line", " ")).alias("word"))
    drawn = _draws(words.select("k1", "size", F.length("word").alias("chars"), F.xxhash64("word").alias("h")))
    vote = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    blocks = [_majority([vote(F.col(f"d{k}_{j}")) for j in range(DRAWS)]) for k in range(BLOCKS)]
    every = [f"d{k}_{j}" for k in range(BLOCKS) for j in range(DRAWS)]
    byte = lambda c, i: F.shiftleft(F.coalesce(F.col(c), F.lit(0)).bitwiseAND(F.lit(255)), 8 * i)
    sketch = [reduce(Column.bitwiseOR, [byte(c, i) for i, c in enumerate(every[8 * k : 8 * k + 8])]).alias(name) for k, name in enumerate(SKETCH)]
    return drawn.select("k1", "short", "long", F.array(*blocks).alias("fp"), *sketch)


def _alike(x: str, y: str) -> Column:
    """How many draws two lines share."""
    differ = F.lit(0)
    for name in SKETCH:
        d = F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}"))
        for step in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(ONES)))
    return F.lit(BLOCKS * DRAWS) - differ


def _most(longer: Column, similarity: float) -> Column:
    """The edit distance up to which lines are similar, the longer of which has so many characters."""
    return F.floor((1 - similarity) * longer + 1e-9).cast("int")


def _may(similarity: float) -> Column:
    """Whether x and y have enough draws in common, and lengths that allow the similarity."""
    apart = F.greatest(F.col("x.short") - F.col("y.long"), F.col("y.short") - F.col("x.long"))
    return (apart <= _most(F.greatest("x.long", "y.long"), similarity)) & (_alike("x", "y") >= ALIKE)


def meetings(prints: DataFrame) -> DataFrame:
    """(at, k1, first, short, long, s0, s1, s2): lines that agree with another on a block, and the least of those that do."""
    rows = prints.select("k1", F.explode(F.transform("fp", lambda v, k: F.xxhash64(k, v))).alias("at")).repartition("at")
    several = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("k1").alias("first")).where("n > 1").select("at", "first")
    met = rows.join(several, "at").select("at", "k1", "first")
    return met.join(prints.drop("fp"), "k1").select("at", "k1", "first", "short", "long", *SKETCH)


def to_first(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): a block's first line with each of its others that may be similar and has enough draws in common with it."""
    first, other = met.where(F.col("k1") == F.col("first")).alias("x"), met.where(F.col("k1") != F.col("first")).alias("y")
    pairs = first.join(other, (F.col("x.at") == F.col("y.at")) & _may(similarity))
    return pairs.select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b")).distinct()


def across(met: DataFrame, groups: DataFrame, similarity: float = 0.0) -> DataFrame:
    """(a, b, ga, gb, shared), a < b, of lines that share a block and enough draws, but no group, one of them outside that
    of the block's first, if their lengths allow the similarity; their groups and how many draws they share."""
    own = groups.select(F.col("node.k1").alias("k1"), F.col("component.k1").alias("own"))
    main = own.select(F.col("k1").alias("first"), F.col("own").alias("main"))
    told = met.join(own, "k1", "left").join(main, "first", "left")
    told = told.select("at", "k1", "short", "long", *SKETCH, F.coalesce("own", "k1").alias("own"), F.coalesce("main", "first").alias("main"))
    out = told.where(F.col("own") != F.col("main"))
    met_in = (F.col("x.at") == F.col("y.at")) & (F.col("x.own") != F.col("y.own"))
    pairs = out.alias("x").join(told.alias("y"), met_in & _may(similarity))
    swap = lambda c: (F.when(F.col("x.k1") < F.col("y.k1"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(F.col("x.k1") < F.col("y.k1"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (a, b), (ga, gb) = swap("k1"), swap("own")
    return pairs.select(a.alias("a"), b.alias("b"), ga.alias("ga"), gb.alias("gb"), _alike("x", "y").alias("shared")).distinct()


def best_between(apart: DataFrame) -> DataFrame:
    """(a, b): of the pairs between two groups the one that shares the most draws."""
    one = apart.groupBy(F.least("ga", "gb"), F.greatest("ga", "gb")).agg(F.max(F.struct("shared", "a", "b")).alias("best"))
    return one.select("best.a", "best.b")


def still_apart(apart: DataFrame, tried: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) of ``apart`` that haven't been tried and whose groups the links found meanwhile don't join."""
    at = apart.select("a", "b", "ga", "gb")
    found = links.select(F.col("a.k1").alias("a"), F.col("b.k1").alias("b")).join(at, ["a", "b"]).select("ga", "gb")
    joined = stored(connected_components(found, "ga", "gb"))
    for g in ("ga", "gb"):
        at = at.join(joined.select(F.col("node").alias(g), F.col("component").alias(f"{g}_now")), g, "left")
    differ = F.coalesce("ga_now", "ga") != F.coalesce("gb_now", "gb")
    return at.where(differ).select("a", "b").join(tried, ["a", "b"], "left_anti")


def linked(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), keys of the pairs of first hashes whose edit similarity is high enough; ``texts`` has (key, line).

    Lines that share a first hash by chance are all compared, so that chance links nothing.
    """
    both = pairs.join(texts.select(F.col("key.k1").alias("a"), F.col("key").alias("p"), F.col("line").alias("x")), "a")
    both = both.join(texts.select(F.col("key.k1").alias("b"), F.col("key").alias("q"), F.col("line").alias("y")), "b")
    longer = F.greatest(F.length("x"), F.length("y"))
    both = both.withColumn("most", _most(longer, similarity)).where(F.abs(F.length("x") - F.length("y")) <= F.col("most"))
    # An upper bound first, piece by piece; the distance itself where that is over the limit.
    most = F.col("most")
    whole = lambda x, y: F.call_function("levenshtein", x, y, most) >= 0
    rests = _let(_rests("x", "y"), lambda r: (F.greatest(F.length(r["x"]), F.length(r["y"])) <= most) | whole(r["x"], r["y"]))
    exact = F.when(longer > LARGE, rests).otherwise(whole(F.col("x"), F.col("y")))
    alike = F.when(_apart(F.col("x"), F.col("y"), most) <= most, True).otherwise(exact)
    return both.where(alike).select(F.col("p").alias("a"), F.col("q").alias("b"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rests(x: str | Column, y: str | Column) -> Column:
    """A struct of two lines without the words that both begin with or end with, but for one at each end, so that the
    blanks between words stay; the edit distance of the rests is that of the lines."""

    def equal(xs: Column, ys: Column) -> Column:  # words that both begin with
        first = F.array_position(F.zip_with(xs, ys, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(first == 0, F.least(F.size(xs), F.size(ys))).otherwise(first - 1).cast("int")

    after = lambda ws, n: F.slice(ws, n + 1, F.greatest(F.size(ws) - n, F.lit(0)))

    def rest(ws: Column, n: Column, m: Column) -> Column:
        skip, end = F.greatest(n - 1, F.lit(0)), F.greatest(m - 1, F.lit(0))
        return F.array_join(F.slice(ws, skip + 1, F.greatest(F.size(ws) - skip - end, F.lit(0))), " ")

    def between(xs: Column, ys: Column) -> Column:
        back = lambda ws, n: F.reverse(after(ws, n))
        return _let(equal(xs, ys), lambda n: _let(equal(back(xs, n), back(ys, n)), lambda m: F.struct(rest(xs, n, m).alias("x"), rest(ys, n, m).alias("y"))))

    return _let(F.split(x, " "), lambda xs: _let(F.split(y, " "), lambda ys: between(xs, ys)))


def _apart(x: Column, y: Column, most: Column) -> Column:
    """An upper bound of the edit distance: the sum over the pieces between places of ``x``, every ``STEP`` characters, whose
    ``ANCHOR`` characters ``y`` has near the same distance from the place before. Where it has not, the piece goes on to
    the next place. Of large pieces (``LARGE``) only the length is taken, and over ``most`` no more is added."""
    length, part = F.length, F.substring
    large = F.greatest(F.lit(LARGE), F.floor(length(x) / 4))

    def cost(p: Column, q: Column) -> Column:
        longer = F.greatest(length(p), length(q))
        return F.when(p == q, 0).when(longer > large, longer).otherwise(F.levenshtein(p, q))

    def place(s: Column, p: Column) -> Column:  # characters of y before the anchor at p, null if it isn't found near by
        mark, straight = part(x, p + 1, F.lit(ANCHOR)), s["j"] + p - s["i"]
        around = F.floor((p - s["i"]) / 2).cast("int") + AROUND
        start = F.greatest(s["j"], straight - around)
        found = F.call_function("locate", mark, part(y, start + 1, straight - start + around + ANCHOR))
        return F.when(part(y, straight + 1, F.lit(ANCHOR)) == mark, straight).when(found > 0, start + found - 1)

    def state(i: Column, j: Column, far: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), far.cast("int").alias("far"))

    def onward(s: Column, p: Column) -> Column:
        def upto(q: Column) -> Column:
            piece = cost(part(x, s["i"] + 1, p - s["i"]), part(y, s["j"] + 1, q - s["j"]))
            return F.when(q.isNull(), s).otherwise(state(p, q, s["far"] + piece))

        return F.when(s["far"] > most, s).otherwise(_let(place(s, p), upto))

    def last(s: Column) -> Column:
        rest = cost(part(x, s["i"] + 1, length(x)), part(y, s["j"] + 1, length(y)))
        return F.when(s["far"] > most, s["far"]).otherwise(s["far"] + rest)

    places = F.when(length(x) < STEP + ANCHOR, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(STEP), length(x) - ANCHOR, F.lit(STEP)))
    return F.aggregate(places, state(F.lit(0), F.lit(0), F.lit(0)), onward, last)


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each line that has an equal or similar one: doc_id, line_no, keep_doc_id, keep_line_no, group_size, kept."""
    every = stored(normalised(raw_lines(docs)))
    seen = every.select("doc_id", "line_no", F.struct("k1", "k2").alias("key"))
    lines = every.where(F.col("n_words") >= WORDS)
    met = stored(meetings(stored(fingerprints(lines))))
    asked = met.select("k1").distinct()
    texts = lines.select("k1", "k2", "line").join(asked, "k1", "left_semi").distinct()
    texts = stored(texts.select(F.struct("k1", "k2").alias("key"), "line"))
    firsts = stored(to_first(met, similarity))
    links = stored(linked(firsts, texts, similarity))
    apart = stored(across(met, connected_components(links, "a", "b"), similarity).join(firsts, ["a", "b"], "left_anti"))
    best = stored(best_between(apart))
    more = stored(linked(best, texts, similarity))
    rest = stored(linked(stored(still_apart(apart, best, more)), texts, similarity))
    groups = connected_components(links.union(more).union(rest), "a", "b")
    distinct = seen.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    rooted = distinct.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("root"), "first", "n")
    rooted = stored(rooted)
    sized = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size")).where(F.col("group_size") > 1)
    named = rooted.join(sized, "root").select("key", "keep", "group_size")
    found = seen.join(named, "key")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no"))
    return found.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), "group_size", kept.alias("kept"))


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` with the lines that aren't kept taken out of their texts."""
    gone = repeats.where(~F.col("kept")).groupBy(F.col("doc_id").alias("named")).agg(F.collect_set("line_no").alias("gone"))
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("named")), "left")
    stay = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(F.col("gone"), k.cast("long")))
    return both.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))).select(*docs.columns)
