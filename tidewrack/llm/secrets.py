"""Secret scans with recursive decoding.

Each text is a worklist of layers, at first the text itself. A layer is scanned for secrets; then the layers that can
be unwrapped from it join the worklist: the layer with its percent escapes decoded, the layer with its Unicode escapes
decoded, and each base64 run, decoded and decompressed. Bytes needn't be clean text: what isn't UTF-8 is read as Latin-1,
and UTF-16 is read too. A run that doesn't decode to clean text or a compressed block is read at all four phases, and a
compressed block is looked for behind each of its separators, since a path or a name may stand before it. A layer equal to
one seen before at the same place is not taken up again, so the worklist ends even where layers contain themselves.
Each layer carries, for every character, the span of the original text it came from, and what is found in a layer is
reported as the span of the original.

Defined results: a null text counts as empty and has no secrets; a run that doesn't decode is left as it is; of
compressed streams that follow each other all whole ones are opened, up to the first that isn't; a compressed block that would decompress to more than ``LARGEST`` bytes, a bomb, is not opened, and such blocks are
counted in ``unopened``; equal spans found on several ways count once; repeated rows get equal answers; an empty table
gives no rows; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

KINDS = ("assign", "access", "hex")
#: Kind, pattern, group whose length counts and its least length; letters of the words in either case.
RULES = (
    ("assign", re.compile(r"""(?:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Bytes that a compressed block may open to, and the shortest base64 run taken up.
LARGEST, SHORTEST = 64 << 20, 12

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}" % SHORTEST)
_BREAK = re.compile(r"\r?\n")
#: Magic bytes of compressed blocks.
_MAGIC = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_SEPARATOR = re.compile(r"[/_+-]+")
#: A secret, or an encoding that can hold one, has as many printable bytes in a row at least.
_HOLDS = re.compile(rb"[\x20-\x7e]{12}")
_BARE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


class Bomb(ValueError):
    """A compressed block that opens to more than ``LARGEST`` bytes."""


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret in plain sight, sorted; leftmost non-overlapping for each kind."""
    found = [(m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(RULES) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    found.sort()
    return found


def _tool(raw: bytes):
    """What decompresses one stream, member or frame."""
    if raw.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if raw.startswith(b"\xfd7zXZ"):
        return lzma.LZMADecompressor()
    if raw.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        return zstandard.ZstdDecompressor()
    return zlib.decompressobj(47)  # zlib's or gzip's header


def _one(raw: bytes, most: int) -> tuple[bytes, bytes]:
    """The content of the first stream, ``most`` bytes or more if it is too large, and what follows it; ValueError if it isn't whole."""
    tool = _tool(raw)
    try:
        if hasattr(tool, "stream_reader"):  # reads on over all frames by itself
            return tool.stream_reader(raw, read_across_frames=True).read(most), b""
        out = tool.decompress(raw, most)
    except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
        raise ValueError(str(e)) from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise ValueError(str(e)) from e
        raise
    if len(out) < most and not tool.eof:
        raise ValueError("cut off")
    return out, tool.unused_data if len(out) < most else b""


def _opened(raw: bytes) -> bytes:
    """A compressed block's content, all streams that follow each other in it; ValueError if the first isn't whole."""
    parts, size = [], 0
    while raw.startswith(_MAGIC):
        try:
            out, raw = _one(raw, LARGEST + 1 - size)
        except ValueError:
            if not parts:
                raise
            break
        parts.append(out)
        size += len(out)
        if size > LARGEST:
            raise Bomb
    return b"".join(parts)


def _readable(raw: bytes) -> str | None:
    """The bytes as text: UTF-8 without control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if _BARE.search(text) else text


def _lenient(raw: bytes) -> list[str]:
    """Readings of bytes that aren't clean text, if they can hold a secret."""
    out = []
    if b"\x00" in raw:
        for code, bare in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])):
            if 2 * bare.count(0) > len(bare):
                out.append(raw[: len(raw) // 2 * 2].decode(code, "replace"))
    if _HOLDS.search(raw):
        try:
            out.append(raw.decode())
        except UnicodeDecodeError:
            out.append(raw.decode("latin-1"))
    return out


def _contents(raw: bytes) -> Iterator[bytes | None]:
    """What a compressed block holds, opened until it is none; None where it is too large to open."""
    opened = set()  # what it holds may be compressed once more, or hold itself
    while raw.startswith(_MAGIC) and raw not in opened:
        opened.add(raw)
        try:
            raw = _opened(raw)
        except Bomb:
            yield None
            return
        except ValueError:
            break
    if len(opened) > 1 or raw not in opened:
        yield raw


def _unbase64(run: str) -> bytes | None:
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _unicode(token: str) -> str | None:
    """The characters of one match of ``_ESCAPE``."""
    if token.startswith("&#"):
        code = int(token[3:-1], 16) if token[2] in "xX" else int(token[2:-1])
    elif token.startswith("\\u{"):
        code = int(token[3:-1], 16)
    elif token.startswith("\\u"):
        units = b"".join(int(h, 16).to_bytes(2, "big") for h in token.split("\\u")[1:])
        return units.decode("utf-16-be", "replace")
    else:
        code = int(token[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Layer:
    """A text and where its characters lie in the original: starts[i] and ends[i], or one span for all."""

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])


def _replaced(layer: _Layer, matches: list[tuple[int, int, str, int]]) -> _Layer:
    """The layer with characters a to b replaced by a decoded text, each of whose characters spans ``wide`` or its share."""
    parts, starts, ends, at = [], [], [], 0
    n = len(layer.text)
    own_starts = layer.starts if layer.starts is not None else np.arange(n)
    own_ends = layer.ends if layer.ends is not None else np.arange(1, n + 1)
    for a, b, text, wide in matches:
        parts.append(layer.text[at:a])
        starts.append(own_starts[at:a])
        ends.append(own_ends[at:a])
        if text:
            if wide:  # so many characters of the layer for each byte of the decoded text
                widths = np.array([len(c.encode()) for c in text]) * wide
                stop = a + np.cumsum(widths)
                first, last = own_starts[stop - widths], own_ends[stop - 1]
            else:
                first, last = np.full(len(text), own_starts[a]), np.full(len(text), own_ends[b - 1])
            parts.append(text)
            starts.append(first)
            ends.append(last)
        at = b
    parts.append(layer.text[at:])
    starts.append(own_starts[at:])
    ends.append(own_ends[at:])
    if layer.whole:
        return _Layer("".join(parts), None, None, layer.whole)
    return _Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _layers(raw: bytes, span: tuple[int, int]) -> Iterator[_Layer | None]:
    """The layers of a compressed block, all at one span."""
    for content in _contents(raw):
        if content is None:
            yield None
        else:
            plain = _readable(content)
            yield from (_Layer(text, None, None, span) for text in ([plain] if plain else _lenient(content)))


def _shifted(bare: str, span: tuple[int, int]) -> Iterator[_Layer | None]:
    """The layers of a run that doesn't decode as a whole: compressed blocks behind its separators, texts at any phase."""
    for m in _SEPARATOR.finditer(bare):
        for k in range(m.start() + 1, m.end() + 1):
            head = _unbase64(bare[k : k + 8])
            if head and head.startswith(_MAGIC):
                rest = bare[k:].rstrip("=")
                yield from _layers(_unbase64(rest[: len(rest) - (len(rest) % 4 == 1)]) or b"", span)
    body = bare.rstrip("=")
    for phase in range(4):
        part = body[phase:]
        raw = _unbase64(part[: len(part) - (len(part) % 4 == 1)])
        yield from (_Layer(text, None, None, span) for text in _lenient(raw or b""))


def _unwrapped(layer: _Layer) -> Iterator[_Layer | None]:
    """The layers directly below; None for a block that is too large to open."""
    text = layer.text
    if "%" in text:
        matches = []
        for m in _PERCENT.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            if raw.startswith(_MAGIC):
                yield from _layers(raw, layer.span(*m.span()))
            plain = _readable(raw)
            if plain is not None:
                matches.append((*m.span(), plain, 3))
            else:  # the printable ASCII bytes among others
                matches += [(k, k + 3, chr(code), 3) for k in range(*m.span(), 3) if 32 <= (code := int(text[k + 1 : k + 3], 16)) < 127]
        if matches:
            yield _replaced(layer, matches)
    if "\\" in text or "&#" in text:
        matches = [(*m.span(), plain, 0) for m in _ESCAPE.finditer(text) if (plain := _unicode(m[0])) is not None]
        if matches:
            yield _replaced(layer, matches)
    for m in _BASE64.finditer(text):
        run, a, b = m[0], *m.span()
        lines = [(a, b, _BREAK.sub("", run))]
        if "\n" in run:  # wrapped, or lines of their own
            at = a
            for line in _BREAK.split(run):
                at = text.index(line, at)
                lines.append((at, at + len(line), line))
                at += len(line)
        for start, end, bare in lines:
            if len(bare) < SHORTEST:
                continue
            raw = _unbase64(bare)
            if not raw:
                yield from _shifted(bare, layer.span(start, end))
                continue
            if raw.startswith(_MAGIC):
                below = list(_layers(raw, layer.span(start, end)))
                yield from below
                if below:
                    continue
            plain = _readable(raw)
            if plain:
                if layer.whole or start + len(bare) != end:
                    yield _Layer(plain, None, None, layer.span(start, end))
                else:
                    widths = np.array([len(c.encode()) for c in plain])
                    stop = np.cumsum(widths)
                    first = start + (stop - widths) * 4 // 3
                    last = np.minimum(start - (-stop * 4 // 3), end)
                    yield _Layer(plain, *((first, last) if layer.starts is None else (layer.starts[first], layer.ends[last - 1])))
            else:
                yield from _shifted(bare, layer.span(start, end))


def secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Secrets in plain sight; all secrets, those of deeper layers at their place in the original; layers; unopened."""
    base = scan(text)
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()  # noqa: E731  layers needn't be kept
    found, seen, unopened = set(base), {(digest(text), 0, len(text))}, 0
    work = deque([_Layer(text, None, None)])
    while work:
        layer = work.popleft()
        for below in _unwrapped(layer):
            if below is None:
                unopened += 1
            elif below.text and (at := (digest(below.text), *below.span(0, len(below.text)))) not in seen:
                seen.add(at)
                found.update((a, k, b) for start, k, end in scan(below.text) for a, b in [below.span(start, end)])
                work.append(below)
    return base, sorted(found), len(seen), unopened


SECRET = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and all (arrays of kind, start, end in code points, end exclusive), layers and unopened.

    One pass over the rows, no shuffle.
    """
    docs = docs.drop("base", "all", "layers", "unopened")
    names = docs.schema.names
    schema = StructType([*docs.schema.fields, StructField("base", ArrayType(SECRET)), StructField("all", ArrayType(SECRET)), StructField("layers", LongType()), StructField("unopened", LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                got = [secrets(t.as_py() or "") for t in part.column(names.index(text))]
                new = [pa.array([listed(g[0]) for g in got], kind), pa.array([listed(g[1]) for g in got], kind), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "base", "all", "layers", "unopened"])

    return docs.mapInArrow(run, schema)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and unopened: blocks too large to be opened."""
    found = find_secrets(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_remove(kinds, a), b)).cast("long") for a, b in (("access", "hex"), ("assign", "hex"), ("assign", "access"))]
    counts = [n.alias(f"n_{kind}") for n, kind in zip(counts, KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), "unopened")
