import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proof_of(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append((i & 1, level[i ^ 1]))
        else:
            out.append(None)
        i //= 2
    return out


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """Every row's result by the definition, all in memory."""
    told = []
    for r in rows:
        leaf = h(*map(field, r))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        seen = h(*map(field, (*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4])))
        told.append((r[2], r[0], leaf, seen))
    langs = sorted({t[0] for t in told}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: sorted((t for t in told if t[0] == v), key=lambda t: (t[1] is not None, t[1] or 0, t[2])) for v in langs}
    levels = {v: levels_of([t[2] for t in trees[v]]) for v in langs}
    trunk = levels_of([levels[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, (_, doc, leaf, seen) in enumerate(trees[v]):
            path = proof_of(levels[v], i) + proof_of(trunk, k)
            at = seen
            for step in path:
                at = h(at) if step is None else h(step[1], at) if step[0] else h(at, step[1])
            out.append((doc, leaf, levels[v][-1][0], trunk[-1][0], h(*(s[1] for s in path if s)), at, at == trunk[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("step", [1, 3, 12])
def test_against_all_in_memory(spark, step):
    rows = [(i, f"s{i % 3}", lang, None if i % 11 == 0 else i, None if i % 13 == 0 else "ü" * (i % 5)) for lang, n in (("en", 37), ("de", 9), (None, 1), ("é", 2), ("fr", 8), ("", 3)) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "s2", "en", 5, "again"), rows[3], rows[3], (2**40, "s", "en", 1, "x" * 70_000)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    found = manifest.manifest(docs, seen={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, step=step)
    want = sorted(brute(rows), key=repr)
    assert got(found) == want and not all(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_leaves(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert got(manifest.verified(spark.createDataFrame(rows, SCHEMA))) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert manifest.verified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, "s", f"l{i % 2}", i, "t") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS leaf", "'x' AS tree", "2 AS idx", "3 AS level", "4 AS node", "5 AS path", "6 AS n", "7 AS block", "8 AS root")
    assert got(manifest.verified(docs)) == sorted(brute(rows), key=repr)


def test_one_hot_tree_over_many_runs(spark):
    rows = [(i // 3, "s", "en", 1, "same") for i in range(5000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(manifest.manifest(docs, step=4)) == sorted((r for r in brute_untampered(rows)), key=repr)


def brute_untampered(rows):
    return [(*r[:5], r[3], True) for r in brute(rows)]
