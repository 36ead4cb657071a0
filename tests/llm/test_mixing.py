import math
import random
import re

from pyspark.sql import functions as F

from tidewrack.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water filling by repetition."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    sources = ["hot"] * 8 + [f"s{k}" for k in range(6)] + ["é", "Z", None]
    rows = [(i, "\n ".join(["w"] * int(rng.paretovariate(1.1) * 5)), rng.choice(sources), "x") for i in range(n)]
    return rows + [(n, None, "empty", "x"), (n + 1, " \t", "empty", "x"), (n + 2, "a b", None, "x"), (None, "a b c", "s1", "x")]


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.taken(docs).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in rows}
    source = {d: s for d, _, s, _ in rows}
    total = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    want = plain_targets(total)
    assert len(got) == len(rows)
    words = dict.fromkeys(total, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        words[s] += r["taken"]
    for s in total:
        largest = max(size[d] for d in size if source[d] == s)  # whole copies come no nearer where one document is most of a source
        assert abs(words[s] - want[s]) <= (largest / 2 if largest > 0.5 * total[s] else max(3, 0.01 * want[s]))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(3)).collect()), key=str)


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", s, 10 + s % 3) for s in range(1, 60)] + [("b", 7, 4)], "source string, size long, n long")
    wanted = mixing.targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights=(1, 100))
    target = {r["source"]: r["target"] for r in wanted.collect()}
    got = mixing.rates(cells, wanted, 1.5, 2.0).collect()
    assert math.isclose(sum(r["size"] * r["n"] * r["rate"] for r in got if r["source"] == "a"), target["a"], rel_tol=1e-8)
    assert [r["rate"] for r in got if r["source"] == "b"] == [2.0]
    free = sorted((r["size"], r["rate"]) for r in got if r["source"] == "a" and r["rate"] < 2)
    slopes = [(math.log(y / 1.5)) / x for x, y in free]
    assert max(slopes) - min(slopes) < 1e-9  # rate = base * exp(tilt * size)


def test_empty(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
