"""Secret scan with a worklist of decoded layers.

A text is scanned, then every part of it that reads as percent escapes, Unicode
escapes, base64 or (inside base64) a compressed stream is decoded to a new
layer, which is scanned and searched for parts again, until no new layer turns
up. A layer already seen at the same place is not followed again, so cycles end;
at a further place its scan is used again. A secret found in a layer is reported
at the place in the original text that it came from.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import sys
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean

KINDS = ("assign", "access", "hex")
# The three base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
# Runs of 16 base64 characters or more, over single line breaks.
ENCODED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=(?:[A-Za-z0-9+/_-]|\r?\n(?=[A-Za-z0-9+/_-])){16})[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}"
)
LEAST_RUN = 16
#: Inside compressed streams, base64 runs and escaped lines are held up to so many bytes.
PIECE_BYTES = 1 << 20
# The patterns are ASCII; the shortest has 12 characters.
_READABLE_RUN = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")
_GZIP = b"\x1f\x8b\x08"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in one layer."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def unescape(line: str) -> tuple[str, list[int], list[int]] | None:
    """The line without its escapes, with each character's start and end there."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at, raw, since = 0, bytearray(), 0

    def flush(upto: int) -> None:
        if raw:  # percent escapes hold UTF-8; the characters share the run's span
            chars = raw.decode("utf-8", "replace")
            single = len(chars) == len(raw)
            for k, ch in enumerate(chars):
                out.append(ch)
                starts.append(since + 3 * k if single else since)
                ends.append(since + 3 * k + 3 if single else upto)
            raw.clear()

    for m in ESCAPE.finditer(line):
        s, e = m.span()
        if s > at or line[s] != "%":
            flush(at)
        for k in range(at, s):
            out.append(line[k])
            starts.append(k)
            ends.append(k + 1)
        if line[s] == "%":
            if not raw:
                since = s
            raw.append(int(line[s + 1 : e], 16))
        else:
            body = line[s:e]
            if body[0] == "\\":
                code = int(body[2:], 16)
            else:
                code = int(body[3:-1], 16) if body[2] in "xX" else int(body[2:-1])
            out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
            starts.append(s)
            ends.append(e)
        at = e
    if not at:
        return None
    flush(at)
    for k in range(at, len(line)):
        out.append(line[k])
        starts.append(k)
        ends.append(k + 1)
    return "".join(out), starts, ends


def readable(data: bytes) -> str | None:
    """Text of printable characters, or None."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def squeezed(head: bytes) -> bool:
    """Whether bytes begin like gzip or zlib."""
    return head[:3] == _GZIP or (len(head) > 1 and head[0] & 15 == 8 and head[0] >> 4 < 8 and (head[0] << 8 | head[1]) % 31 == 0)


class Found:
    """What is known of the layers inside one compressed stream. All of them stand at
    the stream's place, so only the kinds of secrets count."""

    def __init__(self):
        self.kinds: set[int] = set()
        self.followed: set[bytes] = set()
        self.open: set[bytes] = set()

    def done(self) -> bool:
        return len(self.kinds) == len(KINDS)


class Unfolded:
    """The layer that a compressed stream unfolds to, all members. Input comes in
    chunks and goes on in chunks; nothing is held but the window. A stream that has
    been followed already is not followed again: it is known by the digest of its
    first HEAD_BYTES, of all if there are fewer."""

    def __init__(self, found: Found):
        self.found, self.held, self.key, self.dead, self.whole = found, b"", None, False, False
        self.stream, self.into, self.used = zlib.decompressobj(wbits=47), Layer(found), 0

    def feed(self, chunk: bytes) -> None:
        if self.dead or self.found.done():
            return
        if self.key is not None:
            self._inflate(chunk)
            return
        if len(self.held) < PROBE_BYTES:
            # Most bytes that look like a beginning fail at once.
            try:
                zlib.decompressobj(wbits=47).decompress((self.held + chunk)[:PROBE_BYTES], 1 << 12)
            except zlib.error:
                self.dead, self.held = True, b""
                return
        self.held += chunk
        if len(self.held) >= HEAD_BYTES:
            self._begin(self.found.open)

    def _begin(self, known: set) -> None:
        self.key = hashlib.blake2b(self.held[:HEAD_BYTES], digest_size=16).digest()
        held, self.held = self.held, b""
        if self.key in known:
            self.dead = True
            return
        known.add(self.key)
        for k in range(0, len(held), CHUNK_BYTES):
            self._inflate(held[k : k + CHUNK_BYTES])

    def _inflate(self, chunk: bytes) -> None:
        self.used += len(chunk)
        rest = self.held + chunk
        try:
            while rest and not self.dead:
                if self.stream.eof:
                    if len(rest) < 3 or not (rest := rest.lstrip(b"\0")):
                        break
                    if not squeezed(rest):  # text behind the last member
                        self.dead = True
                        break
                    self.stream = zlib.decompressobj(wbits=47)
                got = self.stream.decompress(rest, CHUNK_BYTES)
                rest = self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail
                if got:
                    self.into.feed(got)
        except zlib.error:
            self.dead = True
        self.held = rest

    def close(self) -> None:
        """After this ``whole`` tells whether the stream was sound up to its end, and
        ``used`` how many bytes its sound members took."""
        if self.key is None and self.held and not self.dead:
            self._begin(self.found.followed)
        if self.key is not None:
            try:
                while not self.stream.eof and not self.dead and (got := self.stream.decompress(b"", CHUNK_BYTES)):
                    self.into.feed(got)
            except zlib.error:
                self.dead = True
            self.into.close()
            self.found.open.discard(self.key)
        self.whole = self.stream.eof and not self.held.strip(b"\0")
        self.used = self.used - len(self.held) if self.stream.eof else 0


class Layer:
    """A layer inside a compressed stream, which comes in chunks. Patterns are looked
    for with a small carry. Escaped lines and base64 runs are held up to PIECE_BYTES;
    longer ones are decoded as they come (their lines are then joined whatever their
    widths; of an escaped line what stands more than half a piece before its first
    escape is not decoded again with it)."""

    def __init__(self, found: Found, marks: bool = False):
        self.found, self.marks = found, marks
        self.began, self.start, self.at_head = False, b"", None
        self.tail, self.skip = "", 0
        self.line, self.escaped = "", None
        self.run, self.long = "", None
        self.edge, self.live = b"", []

    def feed(self, chunk: bytes) -> None:
        if self.found.done():
            return
        if not self.began:
            self.start += chunk
            if len(self.start) < 3:
                return
            chunk, self.start = self.start, b""
            self._open(chunk)
        self._take(chunk)

    def _open(self, chunk: bytes) -> None:
        self.began = True
        if squeezed(chunk[:3]):
            self.at_head = Unfolded(self.found)

    def _take(self, chunk: bytes) -> None:
        if self.at_head is not None:
            self.at_head.feed(chunk)
        for stream in self.live:
            stream.feed(chunk)
        if self.marks:
            self.live = [x for x in self.live if not x.dead]
            data = self.edge + chunk
            at = data.find(_GZIP)
            while at >= 0:
                if at or self.edge:  # not at the head
                    stream = Unfolded(self.found)
                    stream.feed(data[at:])
                    if not stream.dead:
                        self.live.append(stream)
                at = data.find(_GZIP, at + 1)
            # What is kept cannot hold a whole mark, so none is met twice.
            self.edge = data[-2:]
        text = chunk.decode("latin-1")
        self._look(text)
        self._lines(text)
        self._runs(text)

    def _look(self, text: str) -> None:
        """Presence of the base patterns. A run of blanks means what one means, so an
        undecided match is short."""
        kinds = self.found.kinds
        data = _BLANKS.sub(" ", self.tail + text)
        upto = self.skip
        if 0 not in kinds and ("=" in data or ":" in data):
            for m in ASSIGN.finditer(data, self.skip):
                if m.end(2) - m.start(2) >= 6:
                    kinds.add(0)
                    break
                if m.end() < len(data):
                    upto = m.end()
        if 1 not in kinds and "AKIA" in data and ACCESS.search(data):
            kinds.add(1)
        if 2 not in kinds and HEX.search(data):
            kinds.add(2)
        self.tail = data[-CARRY:]
        self.skip = max(0, upto - (len(data) - len(self.tail)), len(self.tail) - 18)

    def _child(self, data: bytes, marks: bool = False) -> None:
        child = Layer(self.found, marks)
        for k in range(0, len(data), CHUNK_BYTES):
            child.feed(data[k : k + CHUNK_BYTES])
        child.close()

    def _lines(self, text: str) -> None:
        parts = (self.line + text).split("\n")
        for line in parts[:-1]:
            self._line_ends(line)
        self.line = parts[-1]
        if len(self.line) > PIECE_BYTES:
            cut = len(self.line) - 12
            cut = max(self.line.rfind(c, cut) for c in "%\\&") if any(c in self.line[cut:] for c in "%\\&") else cut
            if self.escaped is None and not (any(c in self.line for c in "%\\&") and ESCAPE.search(self.line)):
                self.line = self.line[-(PIECE_BYTES // 2) :]
                return
            self.escaped = self.escaped or Layer(self.found)
            self.escaped.feed(_unescaped(self.line[:cut]))
            self.line = self.line[cut:]

    def _line_ends(self, line: str) -> None:
        if self.escaped is not None:
            self.escaped.feed(_unescaped(line))
            self.escaped.close()
            self.escaped = None
        elif ("%" in line or "\\" in line or "&#" in line) and ESCAPE.search(line):
            self._child(_unescaped(line))

    def _runs(self, text: str) -> None:
        if self.long is not None:
            m = _RUN_ENDS.search(text)
            self._longer(text[: m.start()] if m else text)
            if m is None:
                return
            self._long_ends()
            text = text[m.start() :]
        text = self.run + text
        cut = len(text.rstrip(_IN_RUN))
        if len(text) - cut > PIECE_BYTES:
            cut = max(cut, text.rfind("=") + 1, text.rfind("\n\n") + 1, text.rfind("\n\r\n") + 1)
        self._decode(text, cut)
        self.run = text[cut:]
        if len(self.run) > PIECE_BYTES:
            self.long = [[Layer(self.found, True), k, ""] for k in range(4)]
            run, self.run = self.run, ""
            self._longer(run)

    def _decode(self, text: str, upto: int) -> None:
        for m in runs_in(text, upto):
            for lines in blocks_in(m):
                body = "".join(text[a:z] for a, z in lines)
                for data in _alignments(body):
                    if squeezed(data[:3]) or _GZIP in data or _READABLE_RUN.search(data):
                        self._child(data, True)

    def _longer(self, text: str) -> None:
        body = text.replace("\n", "").replace("\r", "").translate(_STANDARD)
        for each in self.long:
            layer, skip, rest = each
            if skip:
                each[1] = max(0, skip - len(body))
            rest += body[skip:]
            whole = len(rest) // 4 * 4
            for k in range(0, whole, CHUNK_BYTES):
                layer.feed(base64.b64decode(rest[k : min(k + CHUNK_BYTES, whole)]))
            each[2] = rest[whole:]

    def _long_ends(self) -> None:
        for layer, _, rest in self.long:
            rest = rest[: len(rest) - (len(rest) % 4 == 1)]
            layer.feed(base64.b64decode(rest + "=" * (-len(rest) % 4)))
            layer.close()
        self.long = None

    def close(self) -> None:
        if not self.began and self.start:
            self._open(self.start)
            self._take(self.start)
        if self.found.done():
            return
        for stream in [*self.live, *([self.at_head] if self.at_head else [])]:
            stream.close()
        self._line_ends(self.line)
        if self.long is not None:
            self._long_ends()
        self._decode(self.run, len(self.run))


#: Bytes that are passed on at once, that a stream is tried with, and that tell one
#: stream from another; characters in which every undecided match lies.
CHUNK_BYTES, PROBE_BYTES, HEAD_BYTES, CARRY = 1 << 16, 256, 1 << 20, 24
_BLANKS = re.compile("\x20{2,}")
_IN_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
_RUN_ENDS = re.compile(r"[^A-Za-z0-9+/_\r\n-]|\n\r?\n")
_STANDARD = str.maketrans("-_", "+/")


def _unescaped(line: str) -> bytes:
    """The bytes of a line (a character a byte) without its escapes."""

    def one(m) -> str:
        body = m.group()
        if body[0] == "%":
            return chr(int(body[1:], 16))
        code = int(body[2:], 16) if body[0] == "\\" else int(body[3:-1], 16) if body[2] in "xX" else int(body[2:-1])
        return (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�").encode().decode("latin-1")

    return ESCAPE.sub(one, line).encode("latin-1")


def _alignments(body: str):
    """The bytes of a base64 body at each of its four alignments."""
    body = body.translate(_STANDARD)
    for shift in range(4):
        run = body[shift:]
        run = run[: len(run) - (len(run) % 4 == 1)]
        yield base64.b64decode(run + "=" * (-len(run) % 4))


def kinds_inside(data: bytes, first: int) -> tuple[frozenset, bool, int]:
    """Kinds of secrets at any depth in the compressed stream that begins at
    data[first]; whether it was sound to the end of data; bytes of sound members."""
    # Layers call each other as deep as they are nested.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    found = Found()
    stream = Unfolded(found)
    at, step = first, PROBE_BYTES
    while at < len(data) and not stream.dead and not found.done():
        stream.feed(data[at : at + step])
        at, step = at + step, CHUNK_BYTES
    stream.close()
    return frozenset(found.kinds), stream.whole or found.done(), stream.used


_STRETCH = re.compile(r"[A-Za-z0-9+/_\r\n-]{16,}+={0,2}")


def runs_in(text: str, upto: int):
    """Matches of ENCODED before upto, which lie in stretches of such characters."""
    for m in _STRETCH.finditer(text, 0, upto):
        yield from ENCODED.finditer(text, *m.span())


def blocks_in(m):
    """Lists of (start, end) of lines in a run: lines of one width with the
    shorter last one, and the whole run where that is more."""
    lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
    groups: list[list] = []
    for a, z in lines:
        last = groups[-1] if groups else None
        if last and z - a <= (width := last[0][1] - last[0][0]) and last[-1][1] - last[-1][0] == width:
            last.append((a, z))
        else:
            groups.append([(a, z)])
    return [*groups, lines] if len(groups) > 1 else groups


_LINE = re.compile(r"[A-Za-z0-9+/_-]+")


def unwrap(layer: str, lines: list, upto: int):
    """(text, start, end) of what is readable inside a base64 block, at all four
    alignments, and (kinds, start, end) of compressed streams in it; upto is where
    its padding ends."""
    body = "".join(layer[a:z] for a, z in lines)
    if len(body) < LEAST_RUN:
        return
    before = [0]
    for a, z in lines:
        before.append(before[-1] + z - a)

    def place(k: int) -> int:
        nth = bisect.bisect_right(before, k) - 1
        return lines[nth][0] + k - before[nth]

    for shift, data in enumerate(_alignments(body)):
        at = 0 if squeezed(data[:3]) else data.find(_GZIP, 1)
        whole = False
        while at >= 0 and not whole:  # streams, also behind other bytes
            kinds, sound, used = kinds_inside(data, at)
            if kinds:
                yield kinds, place(shift + at // 3 * 4 + at % 3), upto
            whole = at == 0 and sound
            # What a sound member holds has been looked at.
            at = -1 if sound else data.find(_GZIP, at + max(used, 1))
        if whole:
            continue
        if (text := readable(data)) is not None:
            found = [(text, 0, len(data))]
        else:
            found = ((m.group().decode("ascii"), *m.span()) for m in _READABLE_RUN.finditer(data))
        for text, a, z in found:
            yield text, place(shift + a // 3 * 4 + a % 3), upto if z == len(data) else place(shift + (4 * z + 2) // 3 - 1) + 1


def parts(layer: str):
    """(decoded, starts, ends) of every encoded part of a layer; of a compressed
    stream the kinds of secrets in it instead of what it unfolds to."""
    if "%" in layer or "\\" in layer or "&#" in layer:
        lines, last = set(), -1
        for m in ESCAPE.finditer(layer):
            if m.start() < last:
                continue
            a = layer.rfind("\n", 0, m.start()) + 1
            z = layer.find("\n", m.end())
            last = len(layer) if z < 0 else z
            lines.add((a, last))
        for a, z in sorted(lines):
            if got := unescape(layer[a:z]):
                yield got[0], [a + x for x in got[1]], [a + x for x in got[2]]
    for m in runs_in(layer, len(layer)):
        for lines in blocks_in(m):
            yield from unwrap(layer, lines, m.end() if lines[-1][1] == m.end() - m.group().count("=") else lines[-1][1])


def _mapped(a, z, starts, ends):
    """Starts and ends of a part in the original text, given those of its layer.
    Two numbers instead of lists say that all characters share one span."""
    if starts is None:
        return a, z
    if isinstance(starts, int):
        return starts, ends
    if isinstance(a, int):
        return starts[a], ends[z - 1]
    return [starts[x] for x in a], [ends[x - 1] for x in z]


def secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both by start, kind, end) and the number of layers
    (a layer that stands at several places counts at each)."""
    base = sorted(scan(text))
    every = set(base)
    seen = set()
    known: dict[str, tuple[list, list]] = {}
    work: list = [(text, None, None)]
    while work:
        layer, starts, ends = work.pop()
        if layer not in known:
            known[layer] = scan(layer) if starts is not None else base, list(parts(layer))
        spans, inside = known[layer]
        if isinstance(starts, int):
            every |= {(starts, kind, ends) for _, kind, _ in spans}
        elif starts is not None:
            every |= {(starts[s], kind, max(ends[s:e])) for s, kind, e in spans}
        for inner, a, z in inside:
            a, z = _mapped(a, z, starts, ends)
            place = (inner, a, z) if isinstance(a, int) else (inner, tuple(a), tuple(z))
            if place not in seen and inner != layer:
                seen.add(place)
                if isinstance(inner, str):
                    work.append((inner, a, z))
                else:
                    start, end = (a, z) if isinstance(a, int) else (a[0], max(z))
                    every |= {(start, kind, end) for kind in inner}
    return base, sorted(every), len(seen)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts, spans of base patterns and of all layers per document.

    One narrow pass; null text is empty; repeated rows give repeated results; an
    empty table gives no rows. A text and its decoded layers are held whole by one
    task, an escaped line at some 150 bytes of memory a character; what compressed
    streams unfold to is passed through in chunks, whatever its size, at some 50 kB
    a level of nesting."""
    rows = docs.select("doc_id", "text")
    out = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, "
        "base_spans string, spans string, n_layers long"
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = []
            for raw in as_bytes(b.column("text")):
                base, every, layers = secrets((raw or b"").decode("utf-8", "replace"))
                kinds = [k for _, k, _ in base]
                got.append((*(kinds.count(k) for k in range(3)), joined(base), joined(every), layers))
            cols = list(zip(*got)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"],
            )

    return rows.mapInArrow(lean(run), out)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by [kind]; documents are kept.

    Null and empty texts stay as they are, as do repeated rows; an empty table
    stays empty; long texts are as in find_secrets(). Overlapping spans are replaced as one, named by the first. Columns other
    than text (and n_chars, which follows it) pass through unchanged."""
    schema = docs.schema
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = names.index("text")
            texts = []
            for raw in as_bytes(b.column(at)):
                if raw is None:
                    texts.append(None)
                    continue
                text = raw.decode("utf-8", "replace")
                cut, upto = [], 0
                for s, k, e in secrets(text)[1]:
                    if s >= upto:
                        cut += [text[upto:s], f"[{KINDS[k]}]"]
                    upto = max(upto, e)
                texts.append("".join(cut) + text[upto:] if cut else text)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    done = docs.mapInArrow(lean(run), schema)
    return done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else done
