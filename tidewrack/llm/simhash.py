"""SimHash near-duplicate groups: fingerprints, then a self-join of the binary trie of all distinct fingerprints.

The trie is walked by pairs of nodes at once: each pair carries the bits by which its two prefixes differ, and a pair
whose count passes the budget is dropped with all below it. To deal the walk out, the fingerprint's bits are arranged
so that one of ``budget + 1`` blocks leads; two fingerprints within the budget agree on at least one block, so a walk
below each value of each leading block misses no pair. Where a block value is shared by very many fingerprints, the
bits below it are divided into blocks once more, for those rows only.

Links are not listed: each task joins what it has linked and passes on one edge for each fingerprint that isn't the
first of its group, and ``connected_components`` joins the rest.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any
other; equal texts and repeated rows share a fingerprint and so a group; rows without an id take part, but name no
group unless all of a group lack one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewrack.llm.common import cut
from tidewrack.llm.components import connected_components

BITS = 64
#: A leading block value with more distinct fingerprints than this is divided by further blocks.
CROWD = 20_000
#: Rows that a task walks at once, node pairs handled at once, and pairs of leaves below which a node pair is listed.
AT_ONCE, PAIRS, FEW = 100_000, 400_000, 12
#: Bits set in each byte value, most significant first.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of the text's ``width``-word shingles, A-Z lower-cased, repeats included."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = [np.bincount(hashes[:, k], minlength=256) @ _SET for k in range(8)]
    return int.from_bytes(np.packbits(np.concatenate(ones) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long of the same bits."""
    docs = docs.drop(out)
    kept = [n for n in docs.schema.names if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", width) for t in batch.column(batch.schema.get_field_index(text))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(found.view(np.int64))], names=[*kept, out])

    return docs.mapInArrow(run, StructType([*(docs.schema[n] for n in kept), StructField(out, LongType())]))


def _mask(top: int, width: int) -> int:
    """``width`` ones that begin ``top`` bits below the highest, as a signed long."""
    n = ((1 << width) - 1) << (BITS - top - width) if width else 0
    return n - (1 << BITS) if n >> (BITS - 1) else n


def _lead(x: Column, agreed: int, start: int, width: int) -> Column:
    """``x`` with the block at ``start`` moved up to directly below the ``agreed`` leading bits."""
    parts = [x.bitwiseAND(F.lit(_mask(0, agreed)))] if agreed else []
    parts.append(F.shiftleft(x.bitwiseAND(F.lit(_mask(start, width))), start - agreed))
    if start > agreed:
        parts.append(F.shiftrightunsigned(x.bitwiseAND(F.lit(_mask(agreed, start - agreed))), width))
    parts.append(x.bitwiseAND(F.lit(_mask(start + width, BITS - start - width))))
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def _divide(rows: DataFrame, agreed: int, budget: int) -> DataFrame:
    """Each row once for each block of the bits below ``agreed``, that block leading; ``path`` names the arrangement, in no
    two divisions alike."""
    rest, n = BITS - agreed, budget + 1
    starts = [agreed + rest * k // n for k in range(n)] + [BITS]
    made = [F.struct((F.col("path") * n + k + 1).alias("path"), F.lit(starts[k + 1] - starts[k] + agreed).alias("agreed"), _lead(F.col("x"), agreed, starts[k], starts[k + 1] - starts[k]).alias("x")) for k in range(n)]
    parted = rows.select("fp", F.explode(F.array(*made)).alias("r")).select("fp", "r.*")
    return parted.withColumn("head", F.expr(f"shiftrightunsigned(x, {BITS} - agreed)"))


def _walk(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int, labels: np.ndarray) -> None:
    """Joins in ``labels`` all i, j of a range [lo, hi) whose x differ in at most ``budget`` bits.

    x is sorted and equal in the top ``depth`` bits within a range; each range is a trie node paired with itself.
    """
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a, b, c, d, err = stack.pop()
        few = (b - a) * (d - c) <= FEW
        if depth == BITS:
            few[:] = True
        if few.any():
            _list(x, a[few], b[few], c[few], d[few], budget, labels)
            a, b, c, d, err = (v[~few] for v in (a, b, c, d, err))
        if not len(a):
            continue
        if len(a) > PAIRS:
            for k in range(0, len(a), PAIRS):
                stack.append((depth, *(v[k : k + PAIRS] for v in (a, b, c, d, err))))
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)))
        count = ones[depth]
        m, n, same = b - (count[b] - count[a]), d - (count[d] - count[c]), a == c
        below = [(a, m, c, n, err, None), (m, b, n, d, err, None), (a, m, n, d, err + 1, None), (m, b, c, n, err + 1, ~same)]
        made = []
        for p, q, r, s, e, only in below:
            keep = (q > p) & (s > r) & (e <= budget)
            if only is not None:
                keep &= only
            made.append([v[keep] for v in (p, q, r, s, e)])
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*made))))


def _list(x: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, budget: int, labels: np.ndarray) -> None:
    """The pairs of leaves of small node pairs: compared bit by bit, then joined."""
    n = (b - a) * (d - c)
    for k in range(0, len(n), PAIRS):
        part = slice(k, k + PAIRS)
        size, wide = n[part], (d - c)[part]
        at = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a[part][at] + within // wide[at], c[part][at] + within % wide[at]
        near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
        _join(labels, i[near], j[near])


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes i and j of every pair one group; labels[k] is an earlier member of k's group, the first one's its own."""
    while len(i):
        i, j = _top(labels, i), _top(labels, j)
        apart = i != j
        i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
        np.minimum.at(labels, j, i)


def _top(labels: np.ndarray, i: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := labels[i], i):
        i = up
    return i


def _linked(path: np.ndarray, agreed: np.ndarray, x: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """One edge (fingerprint, first of its group) for each row that is linked to an earlier one."""
    order = np.lexsort((x, path))
    path, agreed, x, fp = path[order], agreed[order], x[order], fp[order]
    labels = np.arange(len(x))
    for depth in np.unique(agreed):
        held = agreed == depth
        head = x >> np.uint64(BITS - int(depth))
        first = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (head[1:] != head[:-1]))))
        lo, hi = first, np.append(first[1:], len(x))
        use = held[lo] & (hi - lo > 1)
        _walk(x, lo[use], hi[use], int(depth), budget, labels)
    top = _top(labels, labels)
    moved = np.flatnonzero(top != np.arange(len(x)))
    return fp[moved], fp[top[moved]]


def trie_links(distinct: DataFrame, budget: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints within ``budget`` bits of each other, from distinct ``fp`` rows."""
    rows = _divide(distinct.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("x")), 0, budget)
    done, agreed = [], 0
    for _ in range(3):
        agreed += (BITS - agreed) // (budget + 1)
        crowded = cut(rows.groupBy("path", "head").count().where(F.col("count") > crowd).select("path", "head"))
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, ["path", "head"], "left_anti").select("fp", "path", "agreed", "x", "head"))
        rows = cut(_divide_each(rows.join(crowded, ["path", "head"], "left_semi"), budget))
    for part in done:
        rows = rows.select("fp", "path", "agreed", "x", "head").union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def edges(part: np.ndarray) -> pa.RecordBatch:
            src, dst = _linked(part[0], part[1], part[2].view(np.uint64), part[3], budget)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]))
            n += batch.num_rows
            if n >= AT_ONCE:
                table = np.concatenate(held, axis=1)
                other = np.flatnonzero((table[0] != table[0, -1]) | (table[4] != table[4, -1]))
                end = int(other[-1]) + 1 if len(other) else 0
                if end:
                    yield edges(table[:, :end])
                held, n = [table[:, end:]], table.shape[1] - end
        if n:
            yield edges(np.concatenate(held, axis=1))

    dealt = rows.select("path", F.col("agreed").cast("long"), "x", "fp", "head").repartition("path", "head").sortWithinPartitions("path", "head")
    return dealt.mapInArrow(run, "src long, dst long")


def _divide_each(rows: DataFrame, budget: int) -> DataFrame:
    """``_divide`` for rows that agree on different numbers of leading bits."""
    depths = sorted(r["agreed"] for r in rows.select("agreed").distinct().collect())  # one for each way to place a block
    parts = [_divide(rows.where(F.col("agreed") == d).select("fp", "path", "x"), d, budget) for d in depths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def rooted(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """``docs`` without its text, with fp, root (the group's own number) and component_id (smallest doc_id of its group)."""
    marked = cut(fingerprints(docs, out="fp", width=width))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(trie_links(nodes.select("fp"), budget))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = cut(named.select("fp", "root", "first"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its group)."""
    found = rooted(docs.select("doc_id", "text"), budget, width)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
