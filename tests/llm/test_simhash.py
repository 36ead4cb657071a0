import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import simhash

MIX = (1 << 64) - 1


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, budget=3):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÉ\t\n x\x1c\xa0", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def _noisy(rng, n):
    roots = [rng.getrandbits(64) for _ in range(6)] + [0]
    out = set()
    while len(out) < n:
        x = rng.choice(roots) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def _grouped(spark, fps, **more):
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.trie_links(spark.createDataFrame(signed, "fp long"), **more).collect()
    top = {x: x for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for e in edges:
        a, b = find(e["src"] & MIX), find(e["dst"] & MIX)
        top[a] = b
    return {frozenset(x for x in fps if find(x) == r) for r in map(find, fps)}


def test_trie_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = _noisy(rng, 400)
    plain = plain_groups(fps)
    expected = {frozenset(fps[i] for i in range(len(fps)) if plain[i] == r) for r in set(plain)}
    assert _grouped(spark, fps) == expected
    assert _grouped(spark, fps, crowd=10) == expected  # crowded block values are divided again


def test_walk_in_one_range_lists_all_pairs():
    rng = random.Random(9)
    x = np.array(sorted(_noisy(rng, 300)), dtype=np.uint64)
    labels = np.arange(len(x))
    simhash._walk(x, np.array([0]), np.array([len(x)]), 0, 3, labels)
    assert simhash._top(labels, labels).tolist() == plain_groups([int(v) for v in x])


def test_documents(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts += [t.upper() for t in texts[:8]] + [t + " tail" for t in texts[:12]] + [None, "", " \n", "one", "one two", "x " * 3000]
    rows = [(i * 7 + 1, t, "other") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [plain_fingerprint(t or "") for _, t, _ in rows]
    group = plain_groups(fps)
    assert len(got) == len(rows)
    for i, (doc_id, _, _) in enumerate(rows):
        assert got[doc_id]["fingerprint"] == f"{fps[i]:016x}"
        assert got[doc_id]["component_id"] == rows[group[i]][0]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_crowds_hide_no_other_block(spark):
    """Pairs that agree on their second block alone, whose value crowds the first block of others."""
    rng = random.Random(11)
    crowd = {0x1234 << 48 | rng.getrandbits(44) for _ in range(120)}
    pairs = [0xFF << 56 | rng.getrandbits(8) << 48 | 0x1234 << 32 | rng.getrandbits(32) for _ in range(15)]
    fps = sorted(crowd | {y for x in pairs for y in (x, x ^ (1 << 48 | 1 << 20 | 1 << 4))})
    plain = plain_groups(fps)
    assert _grouped(spark, fps, crowd=60) == {frozenset(fps[i] for i in range(len(fps)) if plain[i] == r) for r in set(plain)}
