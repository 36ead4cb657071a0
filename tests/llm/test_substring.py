import random

from tidewrack.llm import substring


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def plain_cuts(raw):
    out, last = [], 0
    gear = [int(g) for g in substring.GEAR]
    for end in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, end - 16) : end]:
            h = (h * 2 + gear[b]) % (1 << 16)
        boundary = end == len(raw) or raw[end] & 0xC0 != 0x80
        if end - last == substring.MOST + 1:  # the last boundary at or before MOST
            forced = last + substring.MOST
            while raw[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
            last = forced
        if end == len(raw) or boundary and h < (1 << 16) // substring.AVERAGE and end - last >= substring.LEAST:
            out.append(end)
            last = end
    return out


def test_cuts_are_the_plain_ones():
    rng = random.Random(2)
    for text in [words(rng, 200), "a" * 3000, "é" * 700, "x", words(rng, 3), "\U0001f600" * 300]:
        raw = text.encode()
        got = substring.cuts(raw)
        assert got == plain_cuts(raw)
        assert got[-1] == len(raw) and all(b - a <= substring.MOST for a, b in zip([0, *got], got))


def test_insertions_shift_no_cuts():
    rng = random.Random(4)
    text = words(rng, 400)
    before, after = substring.cuts(text.encode()), substring.cuts(("inserted " + text).encode())
    assert len({b + 9 for b in before} & set(after)) >= len(before) - 3


def test_reflowed():
    for text in ["a  b\n\nc é\t\tü ", "", " \n x", "日本\r\n語"]:
        plain, at = substring.reflowed(text.encode()) if text else (b"", [0])
        assert plain.decode() == __import__("re").sub(r"[\x20\x09-\x0D]+", " ", text)
        for k, c in enumerate(plain):
            if c & 0xC0 != 0x80 and c != 32:
                assert text[at[k]].encode()[0] == c
        assert at[-1] == len(text)


def test_passages(spark):
    rng = random.Random(7)
    passages = [words(rng, 60) for _ in range(30)]
    rows, owners = [], {}
    for i in range(200):
        text = words(rng, rng.randrange(20, 150))
        if i % 3 == 0:
            k = rng.randrange(30)
            owners.setdefault(k, []).append(i)
            passage = passages[k] if i % 2 else passages[k].replace(" ", "\n  ", 3)
            text = f"{text} {passage} {words(rng, 40)}"
        rows.append((i, text, 0))
    rows += [(500, rows[1][1], 0), (501, None, 0), (502, "", 0), (None, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = substring.repeated_passages(docs).collect()
    text = {r[0]: r[1] for r in rows}
    planted = {i for own in owners.values() if len(own) > 1 for i in own} | {1, 500}
    found = {r["doc_id"] for r in got}
    assert found <= planted and len(found) >= 0.97 * len(planted)
    for r in got:
        piece = text[r["doc_id"]][r["start"] : r["end"]]
        assert any(" ".join(piece.split()) in " ".join(t.split()) for i, t in text.items() if i is not None and i != r["doc_id"] and t)
    cleaned = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, substring.repeated_passages(docs)).collect()}
    assert cleaned[1] == text[1] and cleaned[500] == "" and cleaned[501] is None and len(cleaned) == len(rows)
    for r in got:
        if r["removed_chars"] == r["end"] - r["start"]:
            assert text[r["doc_id"]][r["start"] : r["end"]] not in cleaned[r["doc_id"]]
    assert substring.repeated_passages(docs.limit(0)).collect() == []


def test_repeated_ids_and_chunks_held_first(spark):
    rng = random.Random(9)
    passage, other = words(rng, 60), words(rng, 60)
    lead = words(rng, 30)
    rows = [(1, f"{lead} {passage}"), (2, f"{words(rng, 20)} {passage} {other}"), (2, f"{words(rng, 35)} {passage}"), (3, other), (4, f"{other} {lead}")]
    schema = "doc_id long, text string"
    once = substring.repeated_passages(spark.createDataFrame(rows, schema)).collect()
    twice = substring.repeated_passages(spark.createDataFrame(rows * 3, schema)).collect()
    assert sorted(map(str, once)) == sorted(map(str, twice)) and len({r["row"] for r in once if r["doc_id"] == 2}) == 2
    for r in once:
        assert r["end"] - r["start"] >= substring.PASSAGE
    docs = spark.createDataFrame(rows * 2, schema)
    cleaned = [(r["doc_id"], r["text"]) for r in substring.without_passages(docs, substring.repeated_passages(docs)).collect()]
    assert len(cleaned) == 10
    middle = passage[len(passage) // 3 : 2 * len(passage) // 3]
    assert [middle in t for d, t in cleaned if d == 2] == [False] * 4 and all(middle in t for d, t in cleaned if d == 1)


def test_a_chunk_held_first_keeps_no_passage(spark):
    rng = random.Random(10)
    passage, own = words(rng, 60), words(rng, 40)
    docs = spark.createDataFrame([(1, passage), (2, f"{passage}{own}"), (3, own)], "doc_id long, text string")
    found = substring.repeated_passages(docs)
    ((start, end, removed),) = [(r["start"], r["end"], r["removed_chars"]) for r in found.collect() if r["doc_id"] == 2 and r["removed_chars"]]
    cleaned = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, found).collect()}
    assert cleaned[1] == passage and len(cleaned[2]) == len(passage + own) - removed and passage[100:200] not in cleaned[2] and own[60:] in cleaned[2]
