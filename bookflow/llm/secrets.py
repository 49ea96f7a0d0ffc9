"""Secret scans with a worklist of decoded layers.

A text is the first layer. Each layer is scanned for secrets and for encoded
parts: percent escapes, Unicode escapes, base64 runs (at each of the four places
where a group of letters can start, also joined over line ends), and zlib or gzip
data in decoded bytes. A decoded part is a new layer, which joins the worklist
unless the same content was met before in this document, so the work ends at a
fixpoint even where a part decodes to itself. Decoded bytes that are not UTF-8
are scanned with replacement characters. Each character of a layer knows the span of the
original text that it came from, and a finding is mapped back by it.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of secrets. Letters of the keywords count in either case, ASCII only.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of the pattern [0-9a-f]+ that is long enough
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex")
#: A cheap test that must hold where ASSIGN can match.
HINT = re.compile(r"[pP][aA][sS][sS]|[sS][eE][cC][rR]|[tT][oO][kK][eE]|[aA][pP][iI]")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
WIDE_UNICODE = re.compile(r"(?:\\U[0-9A-Fa-f]{8})+")
BYTE_ESCAPES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
#: The least content that tells raw deflate data, which has no header, from chance.
LEAST_DEFLATED = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: A base64 run that goes on over line ends, also written-out ones.
BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{LINE_END.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
#: Where zlib or gzip data may begin inside decoded bytes.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: A compressed part is scanned in pieces of this many bytes, each with the last OVERLAP bytes of the one before.
MOST_UNPACKED = 1 << 26
OVERLAP = 1 << 20
STEP = 1 << 18

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, findings array<struct<kind:string,start:long,end:long,via:string,value:string>>"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three kinds, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    if HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text; `first` and `last` give the original span of each character, or one span of all; None in the text itself.

    `raw` holds the bytes of a layer that was decoded from bytes, and `rest` gives what follows them, if they are a piece.
    """

    __slots__ = ("text", "first", "last", "via", "raw", "rest")

    def __init__(self, text: str, first: np.ndarray | int | None, last: np.ndarray | int | None, via: str, raw: bytes | None = None, rest: Callable[[], Iterator[bytes]] | None = None):
        self.text, self.first, self.last, self.via, self.raw, self.rest = text, first, last, via, raw, rest

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        if isinstance(self.first, int):
            return self.first, self.last
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def mark(self) -> bytes:
        """A digest of the content and, of a decoded layer, its original span."""
        content = self.raw if self.raw is not None else self.text.encode("utf-8", "surrogatepass")
        span = b"" if self.first is None or not self.text else repr(self.origin(0, len(self.text))).encode()
        return hashlib.sha256(hashlib.sha256(content).digest() + span).digest()

    def plain(self) -> bool:
        """Not decoded from bytes, or from bytes that are text."""
        return self.raw is None or ("\ufffd" not in self.text and self.text.translate(BLANKS).isprintable())


BLANKS = dict.fromkeys(map(ord, "\t\r\n"), " ")


def unescaped(layer: Layer, pattern: re.Pattern, width: int, decode, via: str) -> Layer | None:
    """The layer with all escape runs of one sort replaced, and where each character came from."""
    parts, first, last, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        new = decode(m.group())
        changed = True
        parts.append(layer.text[at : m.start()])
        if isinstance(layer.first, int):
            parts.append(new)
            at = m.end()
            continue
        first.append(_firsts(layer, at, m.start()))
        last.append(_lasts(layer, at, m.start()))
        parts.append(new)
        a, z = layer.origin(m.start(), m.end())
        if layer.first is None and len(new) * width == m.end() - m.start():  # one escape a character
            first.append(np.arange(m.start(), m.end(), width))
            last.append(np.arange(m.start(), m.end(), width) + width)
        else:
            first.append(np.full(len(new), a))
            last.append(np.full(len(new), z))
        at = m.end()
    if not changed:
        return None
    parts.append(layer.text[at:])
    if isinstance(layer.first, int):
        return Layer("".join(parts), layer.first, layer.last, f"{layer.via}>{via}")
    first.append(_firsts(layer, at, len(layer.text)))
    last.append(_lasts(layer, at, len(layer.text)))
    return Layer("".join(parts), np.concatenate(first), np.concatenate(last), f"{layer.via}>{via}")


def _firsts(layer: Layer, a: int, z: int) -> np.ndarray:
    return np.arange(a, z) if layer.first is None else layer.first[a:z]


def _lasts(layer: Layer, a: int, z: int) -> np.ndarray:
    return np.arange(a + 1, z + 1) if layer.last is None else layer.last[a:z]


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _unicode(run: str) -> str:
    return binascii.unhexlify(run.replace("\\u", "")).decode("utf-16-be", "replace")


def _wide_unicode(run: str) -> str:
    return binascii.unhexlify(run.replace("\\U", "")).decode("utf-32-be", "replace")


def _byte_escapes(run: str) -> str:
    return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")


#: Escapes of text: a mark that must stand in it, their runs, the letters of one escape, decoder and name.
ESCAPES = (
    ("%", PERCENT, 3, _percent, "url"), ("\\u", UNICODE, 6, _unicode, "unicode"), ("\\U", WIDE_UNICODE, 10, _wide_unicode, "unicode"), ("\\x", BYTE_ESCAPES, 4, _byte_escapes, "bytes"),
)


def wide_texts(raw: bytes) -> Iterator[str]:
    """Bytes read as UTF-16 in either order, where that gives letters of ASCII for the most part."""
    if raw.count(0) * 4 < len(raw):
        return
    for code in ("utf-16-le", "utf-16-be"):
        text = raw.decode(code, "replace")
        if sum(31 < ord(c) < 127 for c in text) * 2 > len(text):
            yield text


def raw_deflated(raw: bytes) -> bool:
    """Whether bytes begin with deflate data without a header: text of some length comes out before any damage."""
    try:
        out = zlib.decompressobj(-zlib.MAX_WBITS).decompress(raw[:STEP], 4096)
    except zlib.error:
        return False
    return len(out) >= LEAST_DEFLATED and sum(31 < b < 127 or b in b"\t\r\n" for b in out) * 4 > 3 * len(out)


def packed_at(raw: bytes) -> Iterator[int]:
    """Places where zlib or gzip data seems to begin."""
    if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 and not PACKED.match(raw):
        yield 0
    yield from (m.start() for m in PACKED.finditer(raw))


def unpacked(chunks: Iterator[bytes], bits: int = zlib.MAX_WBITS | 32) -> Iterator[bytes]:
    """The content of zlib or gzip data, or of deflate data alone, member after member, up to its end or to damage."""
    opened, fresh = zlib.decompressobj(bits), True
    for chunk in chunks:
        full = False
        while chunk or full:
            if fresh and bits > 0 and not (chunk := bytes(chunk).lstrip(b"\0")):  # padding between members
                break
            try:
                out = opened.decompress(chunk, STEP)
            except zlib.error:
                return
            fresh, full = opened.eof, len(out) == STEP and not opened.eof
            chunk = opened.unused_data if opened.eof else opened.unconsumed_tail
            if opened.eof:
                opened = zlib.decompressobj(bits)
            if out:
                yield out


def slices(raw: bytes, start: int) -> Iterator[bytes]:
    return (raw[i : i + STEP] for i in range(start, len(raw), STEP))


def after(chunks: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """The chunks without the first `skip` bytes."""
    for chunk in chunks:
        if skip < len(chunk):
            yield chunk[skip:] if skip else chunk
        skip = max(0, skip - len(chunk))


def pieces(chunks: Callable[[], Iterator[bytes]], span: tuple[int, int], via: str) -> Iterator[Layer]:
    """Layers of the bytes that `chunks` gives: one, or overlapping ones where there are more than MOST_UNPACKED."""
    held, end, new = bytearray(), 0, 0
    for chunk in chunks():
        held += chunk
        end += len(chunk)
        new += len(chunk)
        if len(held) >= MOST_UNPACKED:
            raw = bytes(held)
            yield Layer(raw.decode("utf-8", "replace"), *span, via, raw, lambda skip=end: after(chunks(), skip))
            held, new = held[-OVERLAP:], 0
    if new:
        raw = bytes(held)
        yield Layer(raw.decode("utf-8", "replace"), *span, via, raw)


def from_base64(run: str) -> Iterator[bytes]:
    """The bytes of a base64 run read from each of its first four letters."""
    bare = LINE_END.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = bare[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if k and len(part) < 16:
            break
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def inner_layers(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    for mark, pattern, width, decode, via in ESCAPES:
        if mark in text and (new := unescaped(layer, pattern, width, decode, via)):
            yield new
    for pattern in (BASE64, BASE64_LINES):
        for m in pattern.finditer(text):
            for raw in from_base64(m.group()):
                yield Layer(raw.decode("utf-8", "replace"), *layer.origin(m.start(), m.end()), f"{layer.via}>base64", raw)
    if layer.raw is not None:
        for wide in wide_texts(layer.raw):
            yield Layer(wide, layer.first, layer.last, f"{layer.via}>utf16")
        opened = [(at, zlib.MAX_WBITS | 32) for at in packed_at(layer.raw)]
        opened += [(0, -zlib.MAX_WBITS)] if raw_deflated(layer.raw) else []
        for at, bits in opened:
            def chunks(at: int = at, bits: int = bits) -> Iterator[bytes]:
                return unpacked(chain(slices(layer.raw, at), layer.rest() if layer.rest else ()), bits)

            yield from pieces(chunks, (layer.first, layer.last), f"{layer.via}>deflate")


def scan(text: str) -> tuple[list[Span], list[tuple[str, int, int, str, str]], int]:
    """Base spans, the findings of inner layers (kind, start, end, way, value) and the number of layers.

    An inner finding whose span and kind the base scan has already is not
    repeated, nor is a value that was found the same way at an overlapping span.
    Layers of bytes that are no text count only if something is found there.
    """
    base = base_spans(text)
    whole = Layer(text, None, None, "text")
    seen, known, inner, layers = {whole.mark()}, set(base), [], 1
    met: dict[tuple[str, str, str], list[tuple[int, int]]] = {}
    work = deque([inner_layers(whole)])
    while work:
        layer = next(work[0], None)
        if layer is None:
            work.popleft()
            continue
        if not layer.text or (mark := layer.mark()) in seen:
            continue
        seen.add(mark)
        found = base_spans(layer.text)
        layers += bool(found) or layer.plain()
        for kind, a, z in found:
            start, end = layer.origin(a, z)
            spans = met.setdefault((kind, layer.via, layer.text[a:z]), [])
            if (kind, start, end) not in known and not any(x < end and start < y for x, y in spans):
                spans.append((start, end))
                inner.append((kind, start, end, layer.via, layer.text[a:z]))
        # a large layer is worked off before the next one is made
        (work.appendleft if len(layer.text) >= STEP else work.append)(inner_layers(layer))
    return base, inner, layers


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed (inner kinds after the base ones), comma-joined."""
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(set(spans), key=lambda x: (x[1], rank.get(x[0], len(KINDS)), x[0], x[2])))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "findings")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            base, inner, layers = scan(text)
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            rows["doc_id"].append(doc)
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(base + [(f"{k}@{via.removeprefix('text>')}", a, z) for k, a, z, via, _ in inner]))
            rows["n_layers"].append(layers)
            rows["findings"].append(
                [{"kind": k, "start": a, "end": z, "via": "text", "value": text[a:z]} for k, a, z in base]
                + [{"kind": k, "start": a, "end": z, "via": via, "value": value} for k, a, z, via, value in inner]
            )
        yield pa.RecordBatch.from_pydict(rows, schema=ARROW)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()),
    ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string()), ("value", pa.string())]))),
])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in the whole text of every row, and in what its encoded parts decode to.

    Returns SCHEMA: counts of base findings, a digest of their spans, all spans,
    the number of layers read and the findings with their values. Spans count
    code points of the original text; an inner finding's span is that of the
    encoded characters it came from, and its kind in `spans` names the way, as
    in assign@base64.

    * null text counts as empty: no findings, one layer
    * each row is read on its own, so repeated rows and ids repeat their result
    * an empty table gives no rows; other columns are ignored
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned, SCHEMA)
