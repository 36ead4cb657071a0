import random
import re

import xxhash
from pyspark.sql import functions as F

from tidewrack.llm import lines


def norm(line):
    return re.sub(r"[^a-z0-9é]+", " ", line.lower()).strip(" ")


def h64(number, seed):
    return xxhash.xxh64_intdigest((number & (1 << 64) - 1).to_bytes(8, "little"), seed)


def drawn(line):
    """The draws of each block, None where a draw has no word."""
    out = []
    for k in range(lines.BLOCKS):
        best = [None] * lines.DRAWS
        for w in set(line.split(" ")):
            # Spark hashes an integer literal as four bytes
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), h64(xxhash.xxh64_intdigest(w.encode(), 42), 42))
            one = (h >> 34) // len(w) << 32 | h & 0xFFFFFFFF
            j = (h >> 34) % lines.DRAWS
            best[j] = one if best[j] is None else min(best[j], one)
        out.append(best)
    return out


def fingerprint(line):
    votes = [[h64(d, 42) for d in block if d is not None] for block in drawn(line)]
    return [sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in block) > len(block)) for block in votes]


def alike(x, y):
    low = lambda ds: [(d or 0) & 255 for block in ds for d in block]
    return sum(p == q for p, q in zip(low(x), low(y)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, similarity=0.8):
    seen = [(d, k, norm(x)) for d, t in rows for k, x in enumerate((t or "").split("\n")) if norm(x)]
    kinds = sorted({x for _, _, x in seen})
    long = [len(x.split(" ")) >= 5 for x in kinds]
    fps, draws, top = [fingerprint(x) for x in kinds], [drawn(x) for x in kinds], list(range(len(kinds)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(kinds)):
        for j in range(i):
            met = long[i] and long[j] and any(a == b for a, b in zip(fps[i], fps[j])) and alike(draws[i], draws[j]) >= lines.ALIKE
            if met and 1 - distance(kinds[i], kinds[j]) / max(len(kinds[i]), len(kinds[j])) >= similarity:
                top[find(i)] = find(j)
    groups = {}
    for d, k, x in seen:
        groups.setdefault(find(kinds.index(x)), []).append((d, k))
    return sorted((d, k, *min(g), len(g), (d, k) == min(g)) for g in groups.values() if len(g) > 1 for d, k in g)


def corpus(seed=1):
    rng = random.Random(seed)
    pool = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(pool) for _ in range(rng.randrange(5, 40))) for _ in range(40)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(pool)
            own.append(rng.choice(["{}", "{}!", "  {}", "-- {} --"]).format(" ".join(words)))
            own.append(rng.choice(["", "}", "short line here", rng.choice(base).upper()]))
        rows.append((d + 3, "\n".join(own)))
    return rows


def test_repeated_lines_are_the_plain_ones(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "x y z " * 400), (903, "x y z " * 400)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string")
    got = sorted(tuple(r) for r in lines.repeated_lines(docs).collect())
    assert got == plain(rows)
    assert any(r[4] > 2 for r in got)
    assert len(got) > len(plain(rows, similarity=1.0))  # fuzzy links were found


def test_fingerprints_are_the_plain_ones(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string")
    told = lines.normalised(lines.raw_lines(docs))
    got = {r["line"]: [v & (1 << 64) - 1 for v in r["fp"]] for r in told.where(F.col("n_words") > 0).select("k1", "line").distinct().join(lines.fingerprints(told), "k1").collect()}
    assert got and got == {x: fingerprint(x) for x in got}


def test_links_across_groups_are_found(spark):
    """Lines that aren't like a block's first line, but like another of its lines."""
    docs = spark.createDataFrame(corpus(6), "doc_id long, text string")
    told = lines.normalised(lines.raw_lines(docs))
    met = lines.meetings(lines.fingerprints(told))
    none = spark.createDataFrame([], "node struct<k1: long, k2: long>, component struct<k1: long, k2: long>")
    every = {(r["a"], r["b"]) for r in lines.across(met, none).collect()}
    rows = {}
    for r in met.collect():
        rows.setdefault(r["at"], set()).add((r["k1"], *(r[c] & (1 << 64) - 1 for c in lines.SKETCH)))
    same = lambda x, y: sum((p >> 8 * i ^ q >> 8 * i) & 255 == 0 for p, q in zip(x[1:], y[1:]) for i in range(8))
    assert every == {(x[0], y[0]) for g in rows.values() for x in g for y in g if x[0] < y[0] and same(x, y) >= lines.ALIKE}


def edited(rng, words, part):
    """The words with some exchanged, left out or put in, and letters changed, over about ``part`` of the characters."""
    made = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    out, left = list(words), int(part * len(" ".join(words)))
    while left > 0:
        k = rng.randrange(len(out))
        kind = rng.choice(["letter", "word", "word", "out", "in"])
        if kind == "letter":
            at = rng.randrange(len(out[k]))
            out[k] = out[k][:at] + made(1) + out[k][at + 1 :]
            left -= 1
        elif len(out[k]) + 1 > left:
            left -= 1
        elif kind == "word":
            left -= len(out[k])
            out[k] = made(len(out[k]))
        elif kind == "out" and len(out) > 5:
            left -= len(out.pop(k)) + 1
        elif kind == "in":
            out.insert(k, made(len(out[k])))
            left -= len(out[k]) + 1
    return out


def test_recall_of_similar_lines(spark):
    """Of pairs of an edit similarity of 0.8 or more, whatever their fingerprints, nine in ten are found at each length."""
    rng = random.Random(9)
    made = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10)))
    pairs = []
    for n in (8, 12, 20, 40):
        while len([p for p in pairs if p[0] == n]) < 150:
            x = [made() for _ in range(n)]
            y = edited(rng, x, rng.uniform(0.01, 0.2))
            a, b = " ".join(x), " ".join(y)
            if a != b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.8:
                pairs.append((n, a, b))
    rows = [(k, line) for k, line in enumerate(x for p in pairs for x in p[1:])]
    found = {(r["keep_doc_id"], r["doc_id"]) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {n: sum((2 * k, 2 * k + 1) in found for k, p in enumerate(pairs) if p[0] == n) / 150 for n in (8, 12, 20, 40)}
    print(recall)
    assert min(recall.values()) >= 0.9, recall
    assert all(a // 2 == b // 2 for a, b in found)  # and no others


def test_without_repeats(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    repeats = lines.repeated_lines(docs)
    gone = {(r["doc_id"], r["line_no"]) for r in repeats.collect() if not r["kept"]}
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs, repeats).collect()}
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def test_empty(spark):
    assert lines.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def one_word_changed(seed=5):
    """Pairs of lines of 5 to 60 words that differ in one word of equal length, under a fifth of the characters."""
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    out = []
    while len(out) < 60:
        words = [made(rng.randrange(2, 10)) for _ in range(rng.randrange(5, 61))]
        k = rng.randrange(len(words))
        other = [*words[:k], made(len(words[k])), *words[k + 1 :]]
        if other != words and len(words[k]) < 0.2 * len(" ".join(words)):
            out.append((" ".join(words), " ".join(other)))
    return out


def test_production_finds_what_edit_similarity_alone_finds(spark):
    pairs = one_word_changed()
    rows = [(k, line) for k, line in enumerate(x for pair in pairs for x in pair)] + [(900, "les"), (901, "Les!"), (902, "日本語の行"), (903, "日本語の行"), (904, "--"), (905, "--")]
    got = sorted(tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kinds = [x for pair in pairs for x in pair]
    links = {(i, j) for j in range(len(kinds)) for i in range(j) if abs(len(kinds[i]) - len(kinds[j])) <= 12 and distance(kinds[i], kinds[j]) <= 0.2 * max(len(kinds[i]), len(kinds[j])) + 1e-9}
    assert links == {(2 * k, 2 * k + 1) for k in range(len(pairs))}
    want = [(d, 0, k, 0, 2, d == k) for k, j in sorted(links) for d in (k, j)] + [(d, 0, k, 0, 2, d == k) for k in (900, 902) for d in (k, k + 1)]
    assert got == sorted(want)


def test_similar_lines_whose_only_anchor_moved_are_linked(spark):
    """Two words at a line's start and at the other's end, the only ones that each has once: an alignment that holds on to them
    is far over the limit, the edit distance is not."""
    rest = " ".join(["ab cde"] * 15)
    rows = [(2 * k, f"p{k} q{k} {rest}", f"{rest} p{k} q{k}") for k in range(16)]
    assert all(distance(x, y) <= 0.2 * len(x) for _, x, y in rows)
    pairs = spark.createDataFrame([(k, k + 1) for k, _, _ in rows], "a long, b long")
    texts = spark.createDataFrame([((k + i, 0), line) for k, *both in rows for i, line in enumerate(both)], "key struct<k1: long, k2: long>, line string")
    got = {(r["a"]["k1"], r["b"]["k1"]) for r in lines.linked(pairs, texts).collect()}
    assert got == {(k, k + 1) for k, _, _ in rows}


def test_the_bound_is_never_under_the_distance(spark):
    rng = random.Random(4)
    rows = [("", ""), ("", "a b"), ("é" * 60, "è" * 60), ("de " * 50 + "é", "la " + "de " * 40)]
    for _ in range(60):
        x = [rng.choice(["de", "la", "thé", "onou", "stannt", "x"]) for _ in range(rng.randrange(1, 60))]
        rows.append((" ".join(x), " ".join(edited(rng, x, rng.uniform(0, 0.6)))))
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select("x", "y", lines._apart(F.col("x"), F.col("y"), F.lit(10**6)).alias("bound")).collect()
    assert all(r["bound"] >= distance(r["x"], r["y"]) for r in got)
    assert any(0 < r["bound"] == distance(r["x"], r["y"]) for r in got)


def test_pairs_of_groups_that_met_are_not_tried_again(spark):
    apart = spark.createDataFrame([(1, 3, 1, 3, 20), (2, 3, 1, 3, 15), (1, 4, 1, 4, 20), (2, 4, 1, 4, 15)], "a long, b long, ga long, gb long, shared int")
    best = lines.best_between(apart)
    assert {tuple(r) for r in best.collect()} == {(1, 3), (1, 4)}
    links = spark.sql("SELECT named_struct('k1', 1L, 'k2', 0L) AS a, named_struct('k1', 3L, 'k2', 0L) AS b")
    assert [tuple(r) for r in lines.still_apart(apart, best, links).collect()] == [(2, 4)]


def test_across_leaves_out_only_pairs_whose_lengths_forbid_the_similarity(spark):
    docs = spark.createDataFrame(corpus(6), "doc_id long, text string")
    told = lines.normalised(lines.raw_lines(docs))
    met = lines.meetings(lines.fingerprints(told)).cache()
    none = spark.createDataFrame([], "node struct<k1: long, k2: long>, component struct<k1: long, k2: long>")
    size = {r["k1"]: len(r["line"]) for r in told.collect()}
    every, may = ({(r["a"], r["b"]) for r in lines.across(met, none, s).collect()} for s in (0.0, 0.99))
    assert may == {p for p in every if abs(size[p[0]] - size[p[1]]) <= int((1 - 0.99) * max(size[p[0]], size[p[1]]) + 1e-9)} < every
