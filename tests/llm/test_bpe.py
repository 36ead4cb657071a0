import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})
CODEC = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
TEXTS = ["", " ", "I'll say don't", "日本語 テスト 🎉\x00", "▁ ▁▁ ⁇ ⁇⁇", "  \n\n  x", "<|endoftext|>", "a" * 20_000, "x y z", "\x7f\x80\xff"]


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text):
    coded = CODEC.encode(text)
    assert ids(coded) == PLAIN.encode_ordinary(text)
    assert CODEC.decode(coded) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    coded = CODEC.encode(text)
    assert ids(coded) == PLAIN.encode_ordinary(text)
    assert CODEC.decode(coded) == text.encode()


def test_every_vocabulary_entry_is_one_token():
    texts = [b.decode() for b in RANKS[::97] if b.decode("utf-8", "ignore").encode() == b]
    assert all(ids(CODEC.encode(t)) == PLAIN.encode_ordinary(t) for t in texts)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = {r["doc_id"]: r for r in bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for doc_id, text, _ in rows:
        want = PLAIN.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(want)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).columns == ["doc_id", "text", "token_ids", "decoded"]
    assert bpe.token_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
