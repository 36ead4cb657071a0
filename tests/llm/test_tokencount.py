import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import tokencount
from tidewrack.llm.tokencount import BYTE_COST, MARK, Trie

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = tokencount.read_pieces(PATH)
SMALL = {"▁": -3, "a": -5, "b": -5, "▁a": -4, "ab": -6, "ba": -6, "aba": -9, "▁abab": -11, "bb": -10}


def plain(word, pieces):
    """Best (score, -tokens) of every cut, by trying all."""
    floor = min(pieces.values()) - BYTE_COST
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * floor, best[end - 1][1] - n)]
        options += [(best[k][0] + pieces[word[k:end]], best[k][1] - 1) for k in range(end) if word[k:end] in pieces]
        best[end] = max(options)
    return -best[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), max_size=8))
def test_small_vocabulary(words):
    trie = Trie(SMALL)
    assert trie.count(" ".join(words)) == (len(words), sum(plain(MARK + w, SMALL) for w in words))
    assert len(trie.score) <= 1 + len({(MARK + w)[:k] for w in words for k in range(1, len(w) + 2)})  # a node for each prefix


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_public_vocabulary(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert Trie(PIECES).count(text) == (len(words), sum(plain(MARK + w, PIECES) for w in words))


def test_dropping_the_trie_changes_no_count(monkeypatch):
    texts = [f"the thing {i} thinks then" for i in range(50)]
    whole = list(map(Trie(PIECES).count, texts))
    monkeypatch.setattr(tokencount, "NODES", 20)
    assert list(map(Trie(PIECES).count, texts)) == whole


def test_documents(spark):
    texts = [None, "", " \n", "hello hello world", "日本 𝄞", "x" * 50_000, "hello hello world"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(docs, PATH).collect()}
    assert got == {i: Trie(PIECES).count(t or "") for i, t in enumerate(texts)}
    assert tokencount.token_counts(docs.limit(0), PATH).collect() == []
