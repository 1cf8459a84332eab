"""Secret scans through nested encodings: a worklist of decoded layers.

A layer is a text with, for each of its characters, the span of the original that it came
from. Encoded runs of a layer (URL escapes, Unicode escapes and character references, base64,
compressed data inside base64) open further layers, until none is new. An escaped escape sign
is taken off with what it hides, however often it was escaped."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tideline.llm.common import change_texts, per_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs: a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
URL_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPE = r"\\(?:u005[cC]|x5[cC])*(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8})|u\{([0-9a-fA-F]{1,6})\})|&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"
CHARACTER = re.compile(ESCAPE)
UNICODE = re.compile("(?:" + re.sub(r"\((?!\?)", "(?:", ESCAPE) + ")+")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
BLANKS = re.compile(r"\s+")
PACKED = re.compile(r"(?=H4sI|e[AFJN]|(?<=[+/])[A-Za-z0-9])")  # where gzip or zlib data may begin in base64
CUT = re.compile(r"""[^\sA-Za-z0-9+/_.=:%\\"'-]|(?<=[A-Za-z0-9.])\x20(?=[A-Za-z0-9])|\n(?=\n)""")
CHUNK = 1 << 20  # bytes of compressed data opened at once


@dataclass
class Layer:
    """A text in segments: from place ``starts[i]`` on its characters came from ``lows[i]`` to
    ``highs[i]`` of the original, one by one where ``exact[i]``, else all from the whole span."""

    text: str
    starts: list[int]
    lows: list[int]
    highs: list[int]
    exact: list[bool]

    @classmethod
    def whole(cls, text: str, low: int, high: int, exact: bool) -> Layer:
        return cls(text, [0], [low], [high], [exact])

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original that a span of this layer came from."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        low = self.lows[i] + start - self.starts[i] if self.exact[i] else self.lows[i]
        high = self.lows[j] + end - self.starts[j] if self.exact[j] else self.highs[j]
        return low, high

    def segments(self, start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
        """``length, low, high, exact`` of the segments that make up a span."""
        at = bisect_right(self.starts, start) - 1
        while start < end:
            stop = min(end, self.starts[at + 1]) if at + 1 < len(self.starts) else end
            if self.exact[at]:
                low = self.lows[at] + start - self.starts[at]
                yield stop - start, low, low + stop - start, True
            else:
                yield stop - start, self.lows[at], self.highs[at], False
            start, at = stop, at + 1


def find(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by start and then by kind as listed."""
    out = []
    low = text.lower() if "=" in text or ":" in text else ""
    if low and any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _character(m: re.Match) -> str:
    at = m.lastindex
    code = int(m[at], 10 if at == 5 else 16)
    return chr(code) if code < 0x110000 else "\ufffd"


def _unescape(run: str) -> str:
    text = CHARACTER.sub(_character, run)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _unquote(run: str) -> str:
    return bytes.fromhex("".join(URL_BYTE.findall(run))).decode("utf-8", "replace")


def _starts_packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 1 and raw[0] & 15 == 8 and not (raw[0] << 8 | raw[1]) % 31)


def _member(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    """Opens the zlib or gzip member that begins with ``head`` in bounded chunks. Returns
    what stands behind it, or None if nothing could be opened; broken data ends there."""
    machine, got, data = zlib.decompressobj(47), False, head
    while True:
        try:
            out = machine.decompress(data, CHUNK)
        except zlib.error:
            return b"" if got else None
        if out:
            got = True
            yield out
        if machine.eof:
            return machine.unused_data
        data = machine.unconsumed_tail
        if not data and len(out) < CHUNK:
            data = next(rest, b"")
            if not data:
                return b"" if got else None


def _plain(chunks: Iterator[bytes], above: frozenset = frozenset()) -> Iterator[bytes]:
    """The chunks with compressed data opened: members one after the other, and compressed
    data inside each. Data that holds itself is opened once."""
    chunks = iter(chunks)
    head = next(chunks, b"")
    while head:
        mark = hashlib.blake2b(head, digest_size=16).digest()
        if len(head) < 2:
            head += next(chunks, b"")
        if not _starts_packed(head) or mark in above:
            break
        behind = []

        def member(head: bytes = head, behind: list = behind) -> Iterator[bytes]:
            behind.append((yield from _member(head, chunks)))

        yield from _plain(member(), above | {mark})
        if behind[0] is None:
            break
        head = behind[0] or next(chunks, b"")
    if head:
        yield head
        yield from chunks


def _last_cut(text: str) -> int:
    size = 1024
    while True:
        low = max(0, len(text) - size)
        if (cut := max((m.end() for m in CUT.finditer(text, low)), default=0)) or not low:
            return cut
        size *= 8


def _pieces(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of the chunks in pieces cut where no match and no encoded run can stand;
    bytes that are no UTF-8 become a character that ends both."""
    decoder, kept = codecs.getincrementaldecoder("utf-8")("replace"), []
    for chunk in chunks:
        text = decoder.decode(chunk)
        cut = _last_cut(text)
        if cut:
            yield "".join(kept) + text[:cut]
            kept = []
        kept.append(text[cut:])
    if rest := "".join(kept) + decoder.decode(b"", True):
        yield rest


def _bytes(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _opens(raw: bytes) -> bool:
    """Whether compressed data begins here."""
    if not _starts_packed(raw):
        return False
    try:
        return bool(zlib.decompressobj(47).decompress(raw, 1))
    except zlib.error:
        return False


def _unbase64(run: str) -> Iterator[str]:
    """The texts that a run may hold. Besides the run from its start: compressed data that
    begins further on (behind a prefix), and the other three offsets."""
    body = BLANKS.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    if re.fullmatch("[0-9a-f]+", body):
        return
    raw = _bytes(body)
    if _opens(raw):
        yield from _pieces(_plain([raw]))
        return
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
    else:
        if sum(c.isprintable() or c.isspace() for c in text) >= 0.9 * len(text):
            yield text
            return
    yield from _packed_inside(body)
    yield text
    for at in (1, 2, 3):
        yield _bytes(body[at:]).decode("utf-8", "replace")


def _packed_inside(body: str) -> Iterator[str]:
    """The texts of compressed data that begins inside a base64 run. The run is decoded once per
    offset; broken data costs what was opened of it, and the search goes on behind a member's end."""
    raws: dict[int, memoryview] = {}
    after = 0
    for m in PACKED.finditer(body):
        start = m.start()
        if start < after:
            continue
        offset = start % 4
        if offset not in raws:
            raws[offset] = memoryview(_bytes(body[offset:]))
        raw = raws[offset][(start - offset) // 4 * 3 :]
        if not _starts_packed(bytes(raw[:2])) or not _opens(bytes(raw[:4096])):
            continue
        read = [0]

        def parts(raw: memoryview = raw, read: list[int] = read) -> Iterator[bytes]:
            size = 4096
            while read[0] < len(raw):
                part = bytes(raw[read[0] : read[0] + size])
                read[0] += len(part)
                yield part
                size = min(4 * size, CHUNK)

        given, left = parts(), []

        def members(given: Iterator[bytes] = given, left: list = left) -> Iterator[bytes]:
            head = next(given, b"")
            while _starts_packed(head):
                behind = yield from _member(head, given)
                left.append(behind or b"")
                if not behind:
                    return
                head = behind

        yield from _pieces(_plain(members()))
        if left:
            after = start + max(1, (read[0] - len(left[-1])) // 3 * 4 if left[-1] else 1)


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], str]) -> Layer | None:
    """The whole layer with each encoded run decoded: what stands around a run and what
    the run holds are scanned together."""
    parts, at, upto = [], 0, 0
    out = Layer("", [], [], [], [])

    def add(length: int, low: int, high: int, exact: bool) -> None:
        nonlocal at
        out.starts.append(at)
        out.lows.append(low)
        out.highs.append(high)
        out.exact.append(exact)
        at += length

    for m in pattern.finditer(layer.text):
        parts.append(layer.text[upto : m.start()])
        for segment in layer.segments(upto, m.start()):
            add(*segment)
        if piece := decode(m[0]):
            parts.append(piece)
            add(len(piece), *layer.origin(*m.span()), False)
        upto = m.end()
    if not upto:
        return None
    parts.append(layer.text[upto:])
    for segment in layer.segments(upto, len(layer.text)):
        add(*segment)
    out.text = "".join(parts)
    return out


def _opened(layer: Layer) -> Iterator[Layer]:
    for has, pattern, decode in (("%", URL, _unquote), ("\\", UNICODE, _unescape), ("&#", UNICODE, _unescape)):
        if has == "&#" and "\\" in layer.text:
            continue  # both were taken off together
        if has in layer.text and (below := _replaced(layer, pattern, decode)):
            yield below
    for m in WRAPPED.finditer(layer.text):
        for start, end in _runs(layer.text, *m.span()):
            span = layer.origin(start, end)
            for plain in _unbase64(layer.text[start:end]):
                yield Layer.whole(plain, *span, False)


def _runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The runs that lines of base64 may form: each line alone, unless all are of one width
    as encoders wrap them, and lines together. A last short line may be a word that follows."""
    lines = [(m.start(), m.end()) for m in re.compile(r"[^\s]+").finditer(text, start, end)]
    if len(lines) == 1:
        yield start, end
        return
    width = lines[0][1] - lines[0][0]
    if width % 4 == 0 and all(b - a == width for a, b in lines[:-1]) and lines[-1][1] - lines[-1][0] <= width:
        yield start, end
        if not text[start:end].endswith("="):
            for a, b in lines[1:]:  # compressed data of its own
                if b - a >= 16 and _opens(_bytes(text[a:b].replace("-", "+").replace("_", "/").rstrip("="))):
                    yield a, b
        return
    for a, b in lines:
        if b - a >= 16:
            yield a, b
    yield start, end


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). A secret that a decoded run holds or takes part in has the
    span from the first to the last character of the original it came from. A layer whose
    text was seen at the same place before (cycles, repeats) isn't opened again. Spans are
    code points, end exclusive."""
    base = find(text)
    spans = dict.fromkeys(base)
    work, seen = [_opened(Layer.whole(text, 0, len(text), True))], set()
    while work:  # depth first: one layer of each depth is held at a time
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        digest = hashlib.blake2b(below.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        mark = (*below.origin(0, len(below.text)), digest) if below.text else None
        if mark is None or mark in seen:
            continue
        seen.add(mark)
        for kind, start, end in find(below.text):
            spans.setdefault((kind, *below.origin(start, end)))
        work.append(_opened(below))
    return base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def may_hold(text: str) -> bool:
    """False only if neither a secret nor an encoded run can be in the text."""
    if "%" in text or "\\" in text or "&#" in text or max(map(len, text.split()), default=0) >= 16:
        return True
    low = text.lower()
    return ("=" in low or ":" in low) and any(k in low for k in KEYWORDS)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document; counts and
    digest are of the base spans, ``spans`` has all.

    Null and empty texts have no spans (the digest is of nothing); a decoded layer never
    crosses the run it came from; very long texts are scanned whole."""

    def make():
        def of(text: str) -> tuple:
            base, spans = scan(text) if may_hold(text) else ([], [])
            n = [sum(kind == k for kind, _, _ in base) for k in KINDS]
            return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return of

    return per_text(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def hidden(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one mask."""
    out, upto = [], 0
    for _, start, end in scan(text)[1] if may_hold(text) else []:
        if start >= upto:
            out += [text[upto:start], mask]
        upto = max(upto, end)
    return "".join(out) + text[upto:]


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, other columns as they are, with secrets masked in ``text``."""
    return change_texts(docs, lambda: lambda text: hidden(text, mask))
