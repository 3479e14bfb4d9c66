"""Secret scans by a worklist of decoded layers.

A text is scanned as it is; then every run in it that looks encoded (URL escapes, Unicode escapes and character references, base64, also wrapped over lines) is decoded
into a layer of its own, which is scanned and searched for encoded runs in turn, until nothing new comes up. What decodes to bytes is
searched for gzip, zlib and raw deflate streams, which are unpacked to layers of bytes that are searched so again, and for
readable parts, in one byte or two a character: a match has 12 ASCII characters at least and no decoding lengthens a run, so shorter parts hold none. Every character of a layer knows which characters of the text it came from, so what is found in a layer is reported at
its place in the text. A content is searched once, however often and wherever it comes up, and a stream that only stores bytes isn't one. What may be unpacked is in proportion
to the text; a stream beyond that is reported as unread and masked whole, so nothing stays hidden in it.
"""

from __future__ import annotations

import binascii
import html
import itertools
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import map_texts

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs are found first and then looked into, so that each character is looked at a few times however long the run.
URL, URL_ESCAPE = re.compile(r"[^\s<>]+"), re.compile(r"%[0-9A-Fa-f]{2}")
#: `deep` is an escape of an escape's own sign, however often: unwrapped at once, as a layer each would take quadratic time.
URL_UNIT = re.compile(r"(?P<deep>%(?:25)+(?=[0-9A-Fa-f]{2}))|(?:%[0-9A-Fa-f]{2})+|\+|[^%+]+|%", re.DOTALL)
SOLID = re.compile(r"\S+")
ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-3][0-7]{2})|%u[0-9A-Fa-f]{4}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});?|&[A-Za-z][A-Za-z0-9]{1,31};")
ESCAPE_UNIT = re.compile(r"(?P<deep>\\(?:u005[cC])+(?=u[0-9A-Fa-f]{4})|\\(?:x5[cC])+(?=x[0-9A-Fa-f]{2})|&(?:#38;|#[xX]26;)+(?=#))|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|(?:%u[0-9A-Fa-f]{4})+|(?:\\[0-3][0-7]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});?|&[A-Za-z][A-Za-z0-9]{1,31};|[^\\&%]+|\\|&|%", re.DOTALL)
#: Also over lines that follow each other.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/_-]+(?=[\x20\t]*\r?\n))(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
#: Literal characters, one a byte, and escapes of bytes as programs print them.
LINE = re.compile(r"[^\r\n]+")
BYTE_UNIT = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u\{?00([0-9A-Fa-f]{2})(?:(?<=\{00..)\})?|\\([abtnvfr0\\'\"])|[^\\]+|\\", re.DOTALL)
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[^%]+|%", re.DOTALL)
SHORT = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "0": 0}
DELIMITERS = set("=:'\"&?/,;(`|")
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}"), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){12,}"))
#: The headers of gzip and of zlib, of all window sizes.
PACKED = re.compile(b"(?=\\x1f\\x8b\\x08|" + b"|".join(b"\\x%02x\\x%02x" % (c, f) for c in range(0x08, 0x80, 16) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 32) + b")")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base match, leftmost and not overlapping within a kind, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


#: A text, and where each of its characters starts and ends in the layer above, as arrays: a run can be as long as a document.
Piece = tuple[str, Sequence[int], Sequence[int]]


def spelled(data: bytes, at: int, wide: int = 3) -> Piece:
    """Bytes that are escaped in so many characters each from `at` on as text: UTF-8, or if it isn't that one character a byte."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), range(at, at + wide * len(data), wide), range(at + wide, at + wide * len(data) + wide, wide)
    starts, ends, i = array("q"), array("q"), at
    for c in text:
        starts.append(i)
        i += wide * len(c.encode())
        ends.append(i)
    return text, starts, ends


def from_url(run: str, plus: bool) -> Piece:
    """A run with its escapes resolved; a plus is a blank in a form's encoding only."""
    text, starts, ends = [], array("q"), array("q")
    for m in URL_UNIT.finditer(run):
        unit, a = m[0], m.start()
        if m["deep"]:
            piece = "%", [a], [m.end()]
        elif unit[0] == "%" and len(unit) > 1:
            piece = spelled(bytes.fromhex(unit.replace("%", "")), a)
        else:
            piece = " " if unit == "+" and plus else unit, range(a, a + len(unit)), range(a + 1, a + len(unit) + 1)
        text.append(piece[0])
        starts.extend(piece[1])
        ends.extend(piece[2])
    return "".join(text), starts, ends


def from_escapes(run: str) -> Piece:
    """A run with its backslash escapes resolved; halves of surrogate pairs are joined."""
    text, starts, ends = [], array("q"), array("q")
    for m in ESCAPE_UNIT.finditer(run):
        unit, a = m[0], m.start()
        if m["deep"]:
            text.append(unit[0])
            starts.append(a)
            ends.append(m.end())
        elif unit.startswith(("\\u", "%u")) and len(unit) >= 6 and unit[2] != "{":
            codes = [int(unit[i + 2 : i + 6], 16) for i in range(0, len(unit), 6)]
            i = 0
            while i < len(codes):
                pair = 0xD800 <= codes[i] < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000
                text.append(chr(0x10000 + ((codes[i] - 0xD800) << 10) + codes[i + 1] - 0xDC00) if pair else chr(codes[i]) if not 0xD800 <= codes[i] < 0xE000 else "�")
                starts.append(a + 6 * i)
                i += 1 + pair
                ends.append(a + 6 * i)
        elif len(unit) > 3 and unit[0] == "\\" and unit[1] in "0123":
            piece = spelled(bytes(int(unit[i : i + 3], 8) for i in range(1, len(unit), 4)), a, 4)
            text.append(piece[0])
            starts.extend(piece[1])
            ends.extend(piece[2])
        elif unit[0] == "&" and len(unit) > 2 and unit[1] != "#":
            named = html.unescape(unit)
            text.append(named)
            starts.extend(range(a, m.end()) if named == unit else [a] * len(named))
            ends.extend(range(a + 1, m.end() + 1) if named == unit else [m.end()] * len(named))
        elif len(unit) > 2 and unit[0] in "\\&":
            code = int(unit.strip("\\uUx{}"), 16) if unit[0] == "\\" else int(unit[3:].rstrip(";"), 16) if unit[2] in "xX" else int(unit[2:].rstrip(";"))
            text.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
            starts.append(a)
            ends.append(m.end())
        else:
            text.append(unit)
            starts.extend(range(a, m.end()))
            ends.extend(range(a + 1, m.end() + 1))
    return "".join(text), starts, ends


class Budget:
    """Bytes that may still be unpacked from a text, those read and those made."""

    def __init__(self, left: int):
        self.left = left


def inflated(data: bytes, at: int, window: int, budget: Budget) -> tuple[bytes, int]:
    """What a stream in bytes unpacks to, gzip members that follow included, and where it ends. A stream cut off gives what there is of it."""
    view, out, unpacker = memoryview(data), [], zlib.decompressobj(window)
    while at < len(data) and budget.left > 0:
        block = view[at : at + (1 << 16)]
        try:
            out.append(unpacker.decompress(block, budget.left))
        except zlib.error:
            break
        read = len(block) - len(unpacker.unused_data) - len(unpacker.unconsumed_tail)
        at += read
        budget.left -= read + len(out[-1])
        if unpacker.eof:
            if window < 0 or data[at : at + 3] != b"\x1f\x8b\x08":
                break
            unpacker = zlib.decompressobj(window)
    return b"".join(out), at


def passes_through(data: bytes, at: int, window: int) -> bool:
    """True if a stream is one stored block, whole or cut off: what it holds stands in the data as it is, and is looked at there."""
    if window >= 0 and data[at] != 0x1F:
        at += 2
    elif window >= 0:
        flags = data[at + 3] if len(data) > at + 3 else 0
        at += 10
        if flags & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                at = data.find(0, at) + 1 or len(data)
        at += 2 if flags & 2 else 0
    if len(data) < at + 5 or data[at] & 6:
        return False
    size = int.from_bytes(data[at + 1 : at + 3], "little")
    return size ^ int.from_bytes(data[at + 3 : at + 5], "little") == 0xFFFF and (data[at] & 1 == 1 or at + 5 + size >= len(data))


def deflate_like(data: bytes, at: int) -> bool:
    """False if no deflate block can begin here."""
    kind = data[at] >> 1 & 3
    return kind in (1, 2) or kind == 0 and len(data) > at + 4 and data[at + 1] ^ data[at + 3] == 255 and data[at + 2] ^ data[at + 4] == 255


#: Stands for a stream that there was no budget to unpack.
UNREAD = object()
Layer = tuple[str | bytes | object, Sequence[int], Sequence[int]]


class Same(Sequence):
    """One number so many times."""

    def __init__(self, value: int, size: int):
        self.value, self.size = value, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int | slice) -> int | Same:
        if isinstance(i, slice):
            return Same(self.value, len(range(*i.indices(self.size))))
        if not -self.size <= i < self.size:
            raise IndexError
        return self.value


def streams(data: bytes, place: Callable[[int], tuple[int, int]], stop: int, raw: Iterable[int], budget: Budget, seen: bool) -> Iterator[Layer]:
    """The unpacked streams of bytes: gzip and zlib anywhere, raw deflate at the places `raw`. place: a byte's start and end in the layer above; stop: the last end.

    seen: the bytes themselves are looked at, so streams that only pass them through are left out. Once the budget is spent, all from the next stream on is unread.
    """
    for i, window in itertools.chain(((m.start(), 47) for m in PACKED.finditer(data)), ((i, -15) for i in raw if i < len(data) and deflate_like(data, i))):
        if seen and passes_through(data, i, window):
            continue
        out, n = inflated(data, i, window, budget)
        if budget.left <= 0:
            yield UNREAD, Same(place(i)[0], 1), Same(stop, 1)
            if window < 0:
                return
            continue
        if len(out) >= 12:
            yield out, Same(place(i)[0], len(out)), Same(stop if n == len(data) else place(n - 1)[1], len(out))


def opened(data: bytes, place: Callable[[int], tuple[int, int]], stop: int, budget: Budget, raw: Iterable[int] = (0,)) -> Iterator[Layer]:
    """The readable parts and the unpacked streams of bytes."""
    for m in READABLE.finditer(data):
        yield m[0].decode(), array("q", (place(i)[0] for i in range(m.start(), m.end()))), array("q", (place(i)[1] for i in range(m.start(), m.end())))
    for first, wide in enumerate(WIDE):
        for m in wide.finditer(data) if b"\0" in data else ():
            at = range(m.start() + first, m.end(), 2)
            yield m[0][first::2].decode(), array("q", (place(i)[0] for i in at)), array("q", (place(i)[1] for i in at))
    yield from streams(data, place, stop, raw, budget, True)


def from_base64(run: str, budget: Budget) -> Iterator[Layer]:
    """What a base64 run holds, of either alphabet, with or without padding, on one line or more.

    Encoded text can begin anywhere in a run, as after a path or another line, so each of the four alignments is decoded; raw deflate streams, which have
    no header, are tried where the run, a line or what follows a `/`, `_` or `-` begins.
    """
    places, begins, last = array("q"), [], 0
    for m in [*BREAK.finditer(run), None]:
        begins.append(len(places))
        places.extend(range(last, m.start() if m else len(run.rstrip("="))))
        last = m.end() if m else 0
    body = BREAK.sub("", run).rstrip("=")
    if len(body) < 16:
        return
    begins = sorted({*begins, *(m.end() for m in re.finditer("[/_-]", body))})
    body = body.replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))

        def place(i: int, shift: int = shift) -> tuple[int, int]:
            at = shift + i // 3 * 4 + i % 3
            return places[at], places[at + 1] + 1

        yield from opened(data, place, len(run), budget, [(p - shift) // 4 * 3 for p in begins if p >= shift and p % 4 == shift])


def from_bytes(run: str, unit: re.Pattern, budget: Budget, plus: bool = False) -> Iterator[Layer]:
    """The streams in a run of escaped bytes."""
    data, starts, ends, raw = bytearray(), array("q"), array("q"), [0]
    for m in unit.finditer(run):
        a, code = m.start(), next((g for g in m.groups() if g), None)
        if code is None:
            data += (m[0].replace("+", " ") if plus else m[0]).encode("latin-1", "replace")
            starts.extend(range(a, m.end()))
            ends.extend(range(a + 1, m.end() + 1))
            raw += [len(data) - len(m[0]) + i + 1 for i, c in enumerate(m[0]) if c in DELIMITERS]
            if m[0][-1].isspace():
                raw.append(len(data))
        else:
            data.append(int(code, 16) if len(code) == 2 else SHORT.get(code, ord(code)))
            starts.append(a)
            ends.append(m.end())
    return streams(bytes(data), lambda i: (starts[i], ends[i]), len(run), sorted(set(raw)), budget, False)


def unwrapped(text: str, budget: Budget) -> Iterator[tuple[int, Layer]]:
    """(offset, layer) of all that a layer's encoded runs hold."""
    if URL_ESCAPE.search(text):
        for m in URL.finditer(text):
            if not URL_ESCAPE.search(m[0]):
                continue
            for plus in (False, True) if "+" in m[0] else (False,):
                yield m.start(), from_url(m[0], plus)
                yield from ((m.start(), inner) for inner in from_bytes(m[0], URL_BYTE, budget, plus))
    if ESCAPE.search(text):
        yield from ((m.start(), from_escapes(m[0])) for m in SOLID.finditer(text) if ESCAPE.search(m[0]))
        yield from ((m.start(), inner) for m in LINE.finditer(text) if "\\u" in m[0] or "\\x" in m[0] for inner in from_bytes(m[0], BYTE_UNIT, budget))
    yield from ((m.start(), inner) for m in BASE64.finditer(text) if len(m[0]) >= 16 for inner in from_base64(m[0], budget))


#: Bytes that may be unpacked from a text, and as many more for each of its characters.
UNPACKED, EACH = 64 << 20, 8
Spans = list[tuple[int, int, int]]


def explored(text: str, unpacked: int = UNPACKED) -> tuple[Spans, Spans, Spans]:
    """The base matches of a text, those together with what its decoded layers hold, at their places in the text, and the spans of streams that weren't unpacked.

    Different layers of equal content are searched once: what a content holds, at its places in the content, is then put at each place where it came up. A layer inside itself ends the way.
    """
    budget = Budget(unpacked + EACH * len(text))
    done: dict[str | bytes | object, Iterable[tuple[int, int, int]]] = {UNREAD: [(0, len(KINDS), 1)]}

    def entered(layer: str | bytes) -> list:
        if isinstance(layer, str):
            return [layer, unwrapped(layer, budget), None, set(scan(layer))]
        return [layer, ((0, x) for x in opened(layer, lambda i: (i, i + 1), len(layer), budget)), None, set()]

    base = scan(text)
    above, way = {text}, [[text, unwrapped(text, budget), None, set(base)]]
    while way:
        layer, inners, now, found = way[-1]
        now = now or next(inners, None)
        if now is None:
            done[layer] = found
            above.discard(layer)
            way.pop()
            continue
        offset, (inner, a, b) = now
        way[-1][2] = None
        if not inner or inner in above:
            continue
        if inner not in done:
            way[-1][2] = now
            above.add(inner)
            way.append(entered(inner))
            continue
        found.update((a[s] + offset, kind, b[e - 1] + offset) for s, kind, e in done[inner])
    every = sorted(done[text])
    return base, [x for x in every if x[1] < len(KINDS)], [x for x in every if x[1] == len(KINDS)]


def deep_scan(text: str) -> tuple[Spans, Spans]:
    """The base matches of a text, and those together with what its decoded layers hold, at their places in the text."""
    return explored(text)[:2]


def spelled_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FOUND = T.StructType([T.StructField("base_spans", T.ArrayType(SPAN, False)), T.StructField("secret_spans", T.ArrayType(SPAN, False)), T.StructField("unread_spans", T.ArrayType(SPAN, False))])
CLEANED = T.StructType([T.StructField("text", T.StringType())])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans (matches in the text itself), secret_spans (those, and matches in decoded layers) and unread_spans: kind, start and end in code points.

    A null or empty text holds none. Narrow: texts are not shuffled. From a text UNPACKED bytes are unpacked, and EACH more for each character. A compression bomb has more; from there on
    its streams are unread and stand as such.
    """

    def found(texts: list[str | None]) -> dict[str, list]:
        out = {f: [] for f in FOUND.fieldNames()}
        for t in texts:
            for f, spans in zip(FOUND.fieldNames(), explored(t or ""), strict=True):
                out[f].append([{"kind": (*KINDS, "unread")[k], "start": a, "end": b} for a, k, b in spans])
        return out

    return map_texts(docs, text, found, FOUND)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every secret or unread span of the text, overlapping ones as one, replaced by `mark`. A null text stays null; rows and columns stay."""

    def cleaned(texts: list[str | None]) -> dict[str, list]:
        return {text: [t if t is None else masked(t, hidden(t), mark) for t in texts]}

    return map_texts(docs, text, cleaned, T.StructType([T.StructField(text, T.StringType())])).select(*[F.col(f"`{c}`") for c in docs.columns])


def hidden(text: str) -> Spans:
    _, secrets, unread = explored(text)
    return sorted([*secrets, *unread])


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for start, _, end in spans:
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def digest(column: str):
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(column: str, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
