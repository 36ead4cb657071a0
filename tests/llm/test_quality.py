import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    best = [max([next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j)) for j in range(n) if j != i], default=0) for i in range(n)]
    best = [b if b >= 5 else 0 for b in best]
    base = {p for i, b in enumerate(best) if b for p in range(i, i + 5)}
    over = {p for i, b in enumerate(best) if b >= quality.REPEAT for p in range(i, i + b)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(base), len(over), max(best, default=0)]


texts = st.lists(st.sampled_from(["a", "b", "c#", "é", "\x1c", "\xa0x"]), max_size=60).flatmap(lambda w: st.lists(st.sampled_from([" ", "\n", "\t", "  "]), min_size=len(w), max_size=len(w)).map(lambda s: "".join(map("".join, zip(w, s)))))


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_measures_are_the_plain_ones(some):
    found = quality.measure(some)
    for k, text in enumerate(some):
        assert [found[f][k] for f in quality.FIELDS] == plain(text)


def test_long_repeat():
    block = " ".join(f"w{i}" for i in range(300))
    found = quality.measure([f"{block} x {block}", "y " * 5000, "", " ".join(map(str, range(250_000)))])
    assert found["longest_repeat"] == [300, 4999, 0, 0]
    assert found["n_covered_words"] == [600, 5000, 0, 0]
    assert found["n_words"][3] == 250_000


def test_suffixes_of_one_word_kind():
    assert quality.longest_repeats(np.zeros(20, np.int64), 5).tolist() == [19, *range(19, 4, -1), 0, 0, 0, 0]


def test_documents(spark):
    rng = np.random.default_rng(0)
    some = [None, "", "a b", " ".join(map(str, rng.integers(0, 10_000, 400))), " ".join(map(str, rng.integers(0, 3, 400))), "x\n" * 12]
    some.append(" ".join(f"v{i}" for i in range(3000)) + " " + " ".join(f"v{i}" for i in range(120)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(some)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    for i, text in enumerate(some[:6]):
        n, chars, symbols, dup, repeat, over, longest = plain(text or "")
        failed = n < 10 or 100 * repeat > 20 * n
        assert tuple(got[i])[1:7] == (n, chars, symbols, dup, repeat, failed)
        assert got[i]["kept"] == (not failed and over <= 0.15 * n and longest <= 100)
    assert [got[i]["kept"] for i in range(7)] == [False, False, False, True, False, False, False]
    assert not got[6]["base_failed"]
    assert quality.verdicts(docs.limit(0)).collect() == []


def test_longest_repeats_of_few_kinds_of_words():
    import numpy as np

    rng = random.Random(3)
    for _ in range(150):
        kinds, n = rng.choice([1, 2, 4]), rng.randrange(1, 60)
        words = [rng.randrange(kinds) for _ in range(n)]
        want = [0] * n
        for i in range(n):
            for j in range(i):
                k = 0
                while i + k < n and words[i + k] == words[j + k]:
                    k += 1
                want[i], want[j] = max(want[i], k), max(want[j], k)
        for least in (2, 3, 10):
            assert quality.longest_repeats(np.array(words, np.int64), least).tolist() == [x if x >= least else 0 for x in want]
