import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidewrack.llm import language

KINDS = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "über", "schön", "nicht"], "cc": ["que", "los", "año", "para", "como"]}


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(KINDS))
        rows.append((i, " ".join(rng.choice(KINDS[lang]) for _ in range(rng.randrange(3, 60))).upper() + "! 123 $", lang))
    return rows


def plain_bits(windows, text):
    tables = [defaultdict(Counter) for _ in range(4)]
    for code, n in zip(*windows):
        w = int(code).to_bytes(4, "big")
        for order in range(4):
            tables[order][w[3 - order : 3]][w[3]] += int(n)
    total, padded = 0.0, language.START * 3 + text
    for i in range(3, len(padded)):
        for order in (3, 2, 1, 0):
            table = tables[order].get(padded[i - order : i])
            if not table:
                continue
            both = sum(table.values()) + len(table)
            if padded[i] in table:
                total -= math.log2(table[padded[i]] / both)
                break
            total -= math.log2(len(table) / both)
        else:
            total += 8
    return total


def test_code_lengths_are_the_plain_ones():
    by = defaultdict(list)
    for _, text, lang in corpus():
        by[lang].append(language.letters(text))
    counted = {k: np.unique(np.concatenate([p[2] for p in language._pieces(t)]), return_counts=True) for k, t in by.items()}
    model = language.build(counted)
    texts = [b"", "der schön zzz 日本".encode(), by["aa"][0], b"q"]
    got = model.code_lengths(texts)
    want = [[plain_bits(counted[k], t) for k in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_long_texts_are_cut_with_their_context(monkeypatch):
    texts = [b"abcdefgh" * 40, b"x", b"yz" * 30]
    whole = np.concatenate([p[2] for p in language._pieces(texts)])
    monkeypatch.setattr(language, "AT_ONCE", 16)
    assert np.array_equal(np.concatenate([p[2] for p in language._pieces(texts)]), whole)


def test_tables():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 32, 5000, dtype=np.uint32))
    table = language.Table(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    other = np.setdiff1d(np.arange(1, 5000, dtype=np.uint32), keys)
    assert (table.find(other) == -1).all()


def test_identified(spark):
    rows = [*corpus(), (1000, None, "aa"), (1001, "", None), (1002, " 12 !", "bb"), (1003, "the and thing", None), (1004, "und " * 100_000, "zz")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language.identified(docs).collect()}
    truth = {d: lang for d, _, lang in corpus()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [d for d in truth if got[d]["held_out"]]
    assert len(held) > 50 and sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.97 * len(held)
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    kept = {r["doc_id"] for r in language.known_language(docs).collect()}
    assert kept == set(got) - {1000, 1001, 1002}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identified(docs).collect()} == {"und"}
    assert language.identified(docs.limit(0)).collect() == []
