import hashlib
import random
import zlib

import pytest

from tidewrack.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The whole trie in memory, by the definition; rows of one turn number may not differ."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    nodes = {}
    for conv in own:
        base = conv - (abs(conv) % 100) * (1 if conv > 0 else -1)
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple(own.get(base, [])[:h] + own[conv][h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": set(), "ends": []})
            node["members"].add(conv)
        node["ends"].append(conv)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(nodes[p]["members"]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(v["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(v["members"]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(v["ends"]))).encode()).hexdigest())
        for p, v in nodes.items()
    )


def got(spark, rows, head=conversations.HEAD):
    df = conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA), head)
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed, ids, most=8, words=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é", "a b"][: words + 1])) for c in ids for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("head", [6, 8, conversations.HEAD])
def test_against_all_in_memory(spark, head):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(-250, 700), 120))
    rows = made(1, ids, 14)
    copies = [(c + 100 * k, t, r, x) for k in (7, 8, 1500) for c, t, r, x in rows if c % 3 == 0 and c >= 0]
    rows = sorted(set(rows + copies), key=repr)
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(None, 1, "user", "lost"), (50, None, "user", "first")]
    assert got(spark, rows, head) == brute(rows)


def test_long_shared_conversations(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 60 or c % 2 else "other") for c in (0, 1, 2, 3, 100, 101, 250) for t in range(40 + c % 5 * 20)]
    assert got(spark, rows, 10) == brute(rows) == got(spark, rows)


def test_rows_that_repeat_and_extra_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (7, None, None, None), (300, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS name", "2 AS depth", "3 AS digest", "4 AS family", "5 AS n_convs", "6 AS at")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in conversations.prefix_trie(df).collect()) == brute(rows)


def test_one_conversation_without_turns_of_its_own(spark):
    conv = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(conv, 0, "user", "gone"), (conv, 1, "user", "gone too")]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_empty_table(spark):
    assert got(spark, []) == []


def test_many_families_with_one_conversation(spark):
    rows = [(100 * f + k, t, "user", "same") for f in range(1200) for k in (0, 3) for t in range(3)]
    assert got(spark, rows) == brute(rows)
