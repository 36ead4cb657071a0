import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import secrets

SECRET = 'password = "abcdefghijkl1234"'
FULL = (0, 0, len(SECRET) - 1)  # without the closing quote


def b64(raw):
    return base64.b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def plain_scan(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "ſecret", "toKen", "api_key", "passwd", '"', "'", " ", "=", ":", "AKIA", "AKIAB0", "ABCDEF0123456789", "deadbeef01", "é", "\n", "x.y-z/", "abcdefghijkl"]), max_size=12))
def test_scan_is_the_plain_one(parts):
    assert secrets.scan("".join(parts)) == plain_scan("".join(parts))


@pytest.mark.parametrize(
    "wrap",
    [
        b64,
        lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: "".join(f"&#x{ord(c):x};" for c in t),
        lambda t: b64(gzip.compress(t.encode())),
        lambda t: b64(zlib.compress(t.encode())),
        lambda t: b64(bz2.compress(t.encode())),
        lambda t: b64(lzma.compress(t.encode())),
        lambda t: b64(zstandard.compress(t.encode())),
        lambda t: b64(gzip.compress(zlib.compress(t.encode()))),
        lambda t: b64(b64(b64(t))),
        lambda t: urllib.parse.quote(urllib.parse.quote(b64(t) + "/" + "%", safe=""), safe=""),
        lambda t: "\n".join(re.findall(".{1,76}", b64(gzip.compress((t + " and more " * 30).encode())))),
    ],
)
def test_layers_are_unwrapped(wrap):
    coded = wrap(SECRET)
    text = f"Über dies: {coded} end"
    base, found, layers, unopened = secrets.secrets(text)
    assert layers > 1 and unopened == 0
    at = text.index(coded)
    new = [s for s in found if s not in base and s[1] == 0]
    assert new and all(at <= a < b <= at + len(coded) for a, _, b in new)


def test_spans_map_to_the_original():
    text = "x %70assword%3Dabcdefghijklm y"
    _, found, _, _ = secrets.secrets(text)
    assert found == [(2, 0, text.index(" y"))]
    text = "x \\u0074oken=abcdefghijklm y"
    assert secrets.secrets(text)[1] == [(2, 0, text.index(" y"))]
    inner = f"..... {SECRET} ....."
    text = f"see {b64(inner)} there"
    ((a, k, b),) = secrets.secrets(text)[1]
    assert k == 0 and base64.b64decode(text[4:][(a - 4) // 4 * 4 : -(-(b - 4) // 4) * 4]).decode().startswith(("pass", " pass", ". pass", "assword")) and SECRET[:-1] in base64.b64decode(text[4 + (a - 4) // 4 * 4 : 4 + -(-(b - 4) // 4) * 4]).decode()


def test_same_block_twice_is_found_twice():
    block = b64(f"{SECRET} ")
    assert len(secrets.secrets(f"{block} and {block}")[1]) == 2


def test_bombs_and_nonsense_end():
    bomb = b64(zlib.compress(bytes(secrets.LARGEST + 10)))
    assert secrets.secrets(bomb)[3] == 1
    for text in ["%", "%%25%2525", "\\u00", "\\ud800", "&#9999999;", "=" * 50, "A" * 40, b64(gzip.compress(b"abc")[:-4]), "%41" * 2000, "\\\\u0041" * 50]:
        secrets.secrets(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="%25413\\u{}x&#;abAB+/=\n é", max_size=60))
def test_any_text_ends_with_spans_inside(text):
    base, found, _, _ = secrets.secrets(text)
    assert set(base) <= set(found) and all(0 <= a < b <= len(text) for a, _, b in found)


def test_documents(spark):
    texts = [None, "", SECRET, f"é {SECRET} AKIA{'Z' * 16} {'0a' * 9}", b64(f"{SECRET}  "), "x" * 200_000, SECRET]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in secrets.secret_digests(docs).collect():
        base, found, _, _ = secrets.secrets(texts[r["doc_id"]] or "")
        join = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(join(base).encode()).hexdigest()
        assert r["spans"] == join(found)
    assert secrets.secret_digests(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text",
    [
        b64(gzip.compress(f"\x1b[31m{SECRET}\x1b[0m".encode())),
        b64(gzip.compress(f"grün {SECRET} größe".encode("latin-1"))),
        b64(gzip.compress(f"a {SECRET}".encode("utf-16"))),
        b64(f"über {SECRET}".encode("latin-1")),
        b64(f"a\0{SECRET}\0b"),
        "".join(f"%{b:02X}" for b in gzip.compress(SECRET.encode())),
        "https://h.example/v1/" + b64(f"{SECRET} "),
        "key_" + b64(f"{SECRET} "),
        "a-" + b64(f"{SECRET} "),
        "a-" + b64(gzip.compress(SECRET.encode())),
        "x/yz_" + b64(b64(f"{SECRET} ")),
    ],
)
def test_layers_that_are_no_clean_text(text):
    text = f"see {text} there"
    found = secrets.secrets(text)[1]
    assert any(k == 0 and 4 <= a < b <= len(text) - 6 for a, k, b in found)


def test_all_members_of_a_block_are_opened():
    import base64
    import bz2
    import gzip
    import lzma

    import zstandard

    from tidewrack.llm import secrets

    plain = b"nothing to see in this first part of the block", b"here is password=abcdefghijkl123 for all"
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        text = "see " + base64.b64encode(b"".join(map(pack, plain))).decode() + " end"
        assert [s for s in secrets.secrets(text)[1] if s[1] == 0] == [(4, 0, len(text) - 4)], pack
    cut_off = base64.b64encode(gzip.compress(plain[1]) + gzip.compress(plain[0])[:20]).decode()
    assert any(k == 0 for _, k, _ in secrets.secrets("see " + cut_off)[1])
