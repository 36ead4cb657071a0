import hashlib

import corpus_pipeline
from tidewrack.llm import bpe

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    rows = list(seen)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = [r["doc_id"] for r in docs.collect()]
        if name == "tokenize":
            assert sorted(now) == sorted(rows)
        else:
            assert docs.columns == columns and set(now) <= set(rows)
            assert name == "mix_sources" or len(now) == len(set(now))
            texts = [r["text"] for r in docs.select("text").distinct().collect()]
            if name == "exact_dedup":
                assert len(set(map("".join, map(str.split, texts)))) == len(now)
        rows = now
    whole = {(r["doc_id"], r["ids_sha256"]) for r in docs.collect()}
    assert whole == {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(seen[r["doc_id"]]["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["token_ids"])).hexdigest() and len(r["token_ids"]) == 4 * r["n_tokens"]
    assert bpe.OUT_ROWS > 1


def test_empty_and_null(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "the cat", "en", None, 7), (2, "the cat", "en", "a", 7)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DIR)
        docs.collect()


def test_rows_with_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t, s="a": (i, t, "en", s, len(t))
    unlike = [" ".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:7] for j in range(5 + k % 9)) for k in range(60)]
    copies = [row(1, "the cat sat"), row(1, "the cat sat"), row(2, "the cat sat"), row(2, unlike[0]), row(None, unlike[1]), row(None, unlike[1]), row(1, unlike[2]), row(None, unlike[2]), row(None, "the cat sat")]
    docs = spark.createDataFrame(copies, schema)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in stage(spark, docs, DIR).collect()))
        assert got == sorted([(1, "the cat sat"), (2, unlike[0]), (0, unlike[1]), (1, unlike[2])])
    rows = [row((None, 7, k)[k % 3], t, "ab"[k % 2]) for k, t in enumerate(unlike)] + [row(7, unlike[3], "z")] * 3
    docs = spark.createDataFrame(rows, schema)
    taken = corpus_pipeline.mixing.mix(docs).groupBy("source").sum("copies").collect()
    got = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, DIR).collect()]
    assert {r[0]: r[1] for r in taken if r[1]} == {s: n for s in "abz" if (n := sum(g[3] == s for g in got))}
    assert all(got.count(r) <= 2 * rows.count(r) for r in set(got)) and set(got) <= set(rows)
