import hashlib
import random

import numpy as np

from tidewrack.llm import exact


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        bare = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id))
    out = {}
    for bare, own in groups.items():
        keep = min(own)[1]
        for _, doc_id in own:
            out[doc_id] = (keep, len(own), doc_id == keep, hashlib.sha256(bare.encode()).hexdigest())
    return out


def test_groups(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(9))) for _ in range(300)] + ["long " * 20_000, None, "", " \t\r\n\x0b\x0c", " "]
    rows = list(enumerate(base * 2, start=5))
    got = exact.groups(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == plain(rows)


def test_history_and_non_members(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "ab "), (3, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "ab"), (11, "d"), (12, "d  "), (13, "e"), (14, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["member"], r["keep_id"], r["kept"]) for r in exact.dedup(new, exact.winners(exact.keys(old))).collect()}
    assert got == {10: (True, 1, False), 11: (False, 12, False), 12: (False, 12, True), 13: (False, 13, True), 14: (False, 14, True)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.groups(none).collect() == []
    some = spark.createDataFrame([(1, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in exact.groups(some).collect()) == [(0, 0, True), (0, 1, False), (1, 1, True)]
    big = [(2**60 + 1, "x"), (2**60 + 3, "x"), (None, "y")]
    assert {r["keep_id"] for r in exact.groups(spark.createDataFrame(big, "doc_id long, text string")).collect()} == {2**60 + 1, None}
    assert all(r["kept"] for r in exact.dedup(some.where("doc_id is null"), exact.winners(exact.keys(none))).collect())


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 64, 1000, 4096):
        hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        buckets = rng.integers(0, 1024, n)
        move, slot = exact._placed(hashes, buckets, n)
        assert sorted(slot) == list(range(n))
        assert ((hashes ^ move) % exact.PRIME % n == slot).all()
