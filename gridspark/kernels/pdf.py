"""A small PDF reader and writer on the standard library.

Reads page sizes, text with positions, straight rules and images of files whose streams are plain or Flate-coded, with
object streams but without encryption; text in simple fonts, images of whole-byte or one-bit samples. What a page shows
and this reader cannot (``Page.undrawn``) is named; broken or encrypted files raise PdfError. The writer makes files for tests.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field


class PdfError(ValueError):
    pass


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self) -> bytes:
        kinds = self.info.get("Filter", [])
        out = self.raw
        for kind in [kinds] if isinstance(kinds, str) else kinds:
            if kind not in ("FlateDecode", "Fl"):
                raise PdfError(f"stream filter {kind} is not supported")
            out = zlib.decompressobj().decompress(out)
        return out


@dataclass
class Glyph:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass
class Image:
    """Gray samples, row by row from the top, and their place on the page."""

    x0: float
    y0: float
    x1: float
    y1: float
    w: int
    h: int
    gray: bytes


@dataclass
class Page:
    width: float
    height: float
    words: list[Glyph] = field(default_factory=list)
    rules: list[tuple[float, float, float, float]] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    undrawn: list[str] = field(default_factory=list)


_TOKEN = re.compile(
    rb"(?P<ws>[\x00\t\n\f\r ]+|%[^\r\n]*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])"
    rb"|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<str>\()|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Word(str):
    """A bare word: an operator, or R, true, false, null."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while depth:
        if at >= len(data):
            raise PdfError("unclosed string")
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                out += _ESCAPES.get(e, b"" if e in b"\r\n" else e)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
    return bytes(out), at


def _tokens(data: bytes, at: int = 0):
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup
        if kind == "num":
            yield float(m[0]) if b"." in m[0] else int(m[0]), at
        elif kind == "name":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"]).decode("latin-1")), at
        elif kind == "hex":
            h = re.sub(rb"\s", b"", m["hex"])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
        elif kind == "str":
            value, at = _string(data, at)
            yield value, at
        elif kind != "ws":
            yield _Word(m[0].decode("latin-1")), at


_CONSTANTS = {"true": True, "false": False, "null": None}


def _value(stream, first):
    """One object from the tokens that begin with ``first``."""
    if first == "<<" and isinstance(first, _Word):
        items = _items(stream, ">>")
        return dict(zip(items[::2], items[1::2], strict=False))
    if first == "[" and isinstance(first, _Word):
        return _items(stream, "]")
    if isinstance(first, _Word):
        return _CONSTANTS.get(str(first), first)
    return first


def _items(stream, end: str) -> list:
    out: list = []
    for token, _ in stream:
        if isinstance(token, _Word) and token == end:
            return out
        if isinstance(token, _Word) and token == "R" and len(out) >= 2:
            number = out[-2]
            del out[-2:]
            out.append(Ref(number))
        else:
            out.append(_value(stream, token))
    raise PdfError("unclosed collection")


class Document:
    """The objects of a file, found by scanning it, so a broken cross-reference table does no harm; the last of a number counts."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("encrypted files are not supported")
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            try:
                self.objects[int(m[1])] = self._object(data, m.end())
            except (PdfError, StopIteration, ValueError):
                continue
        for x in list(self.objects.values()):
            if isinstance(x, Stream) and x.info.get("Type") == "ObjStm":
                self._unpack(x)
        roots = [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"]
        if not roots:
            raise PdfError("no catalog")
        self.pages = list(self._kids(roots[-1].get("Pages"), {}, set()))

    def _object(self, data: bytes, at: int):
        stream = _tokens(data, at)
        first, end = next(stream)
        position = [end]

        def counted():
            for token, after in stream:
                position[0] = after
                yield token, after

        value = _value(counted(), first)
        m = re.compile(rb"\s*stream\r?\n").match(data, position[0])
        if isinstance(value, dict) and m:
            n = value.get("Length")
            if isinstance(n, Ref):
                found = re.search(rb"(?<!\d)%d\s+\d+\s+obj\s+(\d+)" % n.number, data)
                n = int(found[1]) if found else None
            if n is None or not re.compile(rb"\s*endstream").match(data, m.end() + n):
                n = data.index(b"endstream", m.end()) - m.end()
            return Stream(value, data[m.end() : m.end() + n])
        return value

    def _unpack(self, x: Stream) -> None:
        data, n, first = x.data(), self.get(x.info["N"]), self.get(x.info["First"])
        head = [t for t, _ in _tokens(data[:first])][: 2 * n]
        for number, at in zip(head[::2], head[1::2], strict=True):
            stream = _tokens(data, first + at)
            self.objects.setdefault(number, _value(stream, next(stream)[0]))

    def get(self, x):
        for _ in range(16):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        raise PdfError("references go round")

    def _kids(self, node, inherited: dict, seen: set):
        if isinstance(node, Ref):
            if node.number in seen:
                raise PdfError("the page tree goes round")
            seen = seen | {node.number}
        node = self.get(node)
        if not isinstance(node, dict):
            return
        have = inherited | {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
        if "Kids" in node:
            for kid in self.get(node["Kids"]):
                yield from self._kids(kid, have, seen)
        else:
            yield node | have

    def page(self, i: int) -> Page:
        node = self.pages[i]
        box = [float(self.get(v)) for v in self.get(node.get("MediaBox")) or (0, 0, 0, 0)]
        page = Page(abs(box[2] - box[0]), abs(box[3] - box[1]))
        contents = self.get(node.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(x.data() for x in map(self.get, parts) if isinstance(x, Stream))
        _Interpreter(self, node, page, min(box[0], box[2]), max(box[1], box[3])).run(data)
        return page


def _times(a, b):
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _gray(doc: Document, x: Stream, w: int, h: int) -> bytes:
    """The gray values of an image of DeviceGray, DeviceRGB or DeviceCMYK samples, or of a one-bit image or mask."""
    bits = doc.get(x.info.get("BitsPerComponent")) or 1
    space = doc.get(x.info.get("ColorSpace")) or "DeviceGray"
    kinds = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "DeviceCMYK": 4}
    name = doc.get(space[0]) if isinstance(space, list) and space else space
    if name == "ICCBased":
        n = doc.get(doc.get(space[1]).info["N"])
    elif name in kinds:
        n = kinds[name]
    else:
        raise PdfError(f"colour space {name}")
    if "DecodeParms" in x.info and (doc.get(doc.get(x.info["DecodeParms"]) or {}) or {}).get("Predictor", 1) != 1:
        raise PdfError("predicted samples")
    flip = [float(v) for v in doc.get(x.info.get("Decode")) or (0, 1)][0] == 1
    data = x.data()
    if bits == 1 and n == 1:
        rows = [data[i : i + (w + 7) // 8] for i in range(0, h * ((w + 7) // 8), (w + 7) // 8)]
        out = b"".join(bytes(255 * (row[i >> 3] >> (7 - (i & 7)) & 1) for i in range(w)) for row in rows)
    elif bits == 8 and n == 1:
        out = data[: w * h]
    elif bits == 8 and n == 3:
        out = bytes((299 * r + 587 * g + 114 * b) // 1000 for r, g, b in zip(data[0 : 3 * w * h : 3], data[1 : 3 * w * h : 3], data[2 : 3 * w * h : 3], strict=True))
    elif bits == 8 and n == 4:
        ink = zip(*(data[i : 4 * w * h : 4] for i in range(4)), strict=True)
        out = bytes(max(0, 255 - k - (299 * c + 587 * m + 114 * y) // 1000) for c, m, y, k in ink)
    else:
        raise PdfError(f"samples of {bits} bits")
    if len(out) != w * h:
        raise PdfError("too few samples")
    return bytes(255 - v for v in out) if flip else out


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class _Interpreter:
    """Runs a content stream: text becomes words at their place, axis-parallel strokes and thin fills become rules."""

    def __init__(self, doc: Document, node: dict, page: Page, left: float, top: float) -> None:
        self.doc, self.page, self.left, self.top = doc, page, left, top
        resources = doc.get(node.get("Resources")) or {}
        self.resources(resources)
        self.depth = 0
        self.ctm, self.saved = _UNIT, []
        self.tm = self.line = _UNIT
        self.size, self.leading, self.char, self.word, self.scale = 1.0, 0.0, 0.0, 0.0, 1.0
        self.widths: dict[int, float] = {}
        self.at, self.path = (0.0, 0.0), []

    def resources(self, found: dict) -> None:
        self.fonts, self.objects = (self.doc.get(found.get(k)) or {} for k in ("Font", "XObject"))

    def draw(self, name):
        """An image, or a form: a content stream of its own."""
        x = self.doc.get(self.objects.get(name))
        if not isinstance(x, Stream):
            return
        try:
            if x.info.get("Subtype") == "Form" and self.depth < 8:
                kept = self.ctm, self.fonts, self.objects, self.saved
                self.ctm, self.saved = _times(tuple(map(float, self.doc.get(x.info.get("Matrix")) or _UNIT)), self.ctm), []
                if inner := self.doc.get(x.info.get("Resources")):
                    self.resources(inner)
                self.depth += 1
                self.run(x.data())
                self.depth -= 1
                self.ctm, self.fonts, self.objects, self.saved = kept
            elif x.info.get("Subtype") == "Image":
                w, h = (int(self.doc.get(x.info[k])) for k in ("Width", "Height"))
                gray = _gray(self.doc, x, w, h)
                (xa, ya), (xb, yb) = self._point(_UNIT, 0, 1), self._point(_UNIT, 1, 0)
                if abs(self.ctm[1]) + abs(self.ctm[2]) > 1e-6 or self.ctm[0] < 0 or self.ctm[3] < 0:
                    raise PdfError("turned image")
                self.page.images.append(Image(min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb), w, h, gray))
        except (PdfError, KeyError, TypeError, ValueError, zlib.error) as e:
            self.page.undrawn.append(f"{x.info.get('Subtype')} {name}: {e}")

    def run(self, data: bytes) -> None:
        stack: list = []
        stream = _tokens(data)
        for token, _ in stream:
            if isinstance(token, _Word) and token not in ("<<", "[") and str(token) not in _CONSTANTS:
                do = getattr(self, _OPERATORS.get(str(token), ""), None)
                if do:
                    try:
                        do(*stack)
                    except (TypeError, ValueError):
                        pass
                stack = []
            else:
                stack.append(_value(stream, token))

    def save(self):
        self.saved.append(self.ctm)

    def restore(self):
        self.ctm = self.saved.pop() if self.saved else self.ctm

    def concat(self, *m):
        self.ctm = _times(m, self.ctm)

    def begin(self):
        self.tm = self.line = _UNIT

    def font(self, name, size):
        self.size = float(size)
        font = self.doc.get(self.fonts.get(name)) or {}
        first, widths = self.doc.get(font.get("FirstChar")) or 0, self.doc.get(font.get("Widths")) or []
        self.widths = {first + i: float(self.doc.get(w)) / 1000 for i, w in enumerate(widths)}

    def move(self, x, y):
        self.line = self.tm = _times((1, 0, 0, 1, x, y), self.line)

    def move_leading(self, x, y):
        self.leading = -y
        self.move(x, y)

    def matrix(self, *m):
        if len(m) == 6:
            self.line = self.tm = tuple(float(v) for v in m)

    def next_line(self):
        self.move(0, -self.leading)

    def set_leading(self, v):
        self.leading = v

    def set_char(self, v):
        self.char = v

    def set_word(self, v):
        self.word = v

    def set_scale(self, v):
        self.scale = v / 100

    def show(self, text: bytes):
        self._place(text)

    def show_line(self, text: bytes):
        self.next_line()
        self._place(text)

    def show_spaced(self, word, char, text: bytes):
        self.word, self.char = word, char
        self.show_line(text)

    def show_all(self, items: list):
        for x in items:
            if isinstance(x, bytes):
                self._place(x)
            else:
                self.tm = _times((1, 0, 0, 1, -x / 1000 * self.size * self.scale, 0), self.tm)

    def _point(self, m, x: float, y: float) -> tuple[float, float]:
        m = _times(m, self.ctm)
        return x * m[0] + y * m[2] + m[4] - self.left, self.top - (x * m[1] + y * m[3] + m[5])

    def _place(self, text: bytes) -> None:
        """A word for each run without spaces; widths are the font's, or half an em."""
        begun: list[str] = []
        start = self.tm
        for c in text + b" ":
            if c == 32 or not begun:
                if begun and c == 32:
                    x0, y0 = self._point(start, 0, self.size * 0.75)
                    x1, y1 = self._point(self.tm, 0, -self.size * 0.25)
                    self.page.words.append(Glyph("".join(begun), min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
                    begun = []
                start = self.tm
            if c != 32:
                begun.append(bytes([c]).decode("cp1252", "replace"))
            step = (self.widths.get(c, 0.5) * self.size + self.char + (self.word if c == 32 else 0)) * self.scale
            self.tm = _times((1, 0, 0, 1, step, 0), self.tm)
        back = (self.widths.get(32, 0.5) * self.size + self.char + self.word) * self.scale
        self.tm = _times((1, 0, 0, 1, -back, 0), self.tm)

    def path_move(self, x, y):
        self.at = self._point(_UNIT, x, y)

    def path_line(self, x, y):
        to = self._point(_UNIT, x, y)
        self.path.append((*self.at, *to))
        self.at = to

    def path_box(self, x, y, w, h):
        a, b = self._point(_UNIT, x, y), self._point(_UNIT, x + w, y + h)
        (x0, y0), (x1, y1) = a, b
        self.path += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]

    def stroke(self):
        self.page.rules += [s for s in self.path if abs(s[0] - s[2]) < 1 or abs(s[1] - s[3]) < 1]
        self.path = []

    def drop(self):
        self.path = []


_OPERATORS = {
    "q": "save", "Q": "restore", "cm": "concat", "BT": "begin", "Tf": "font", "Td": "move", "TD": "move_leading", "Tm": "matrix", "T*": "next_line",
    "TL": "set_leading", "Tc": "set_char", "Tw": "set_word", "Tz": "set_scale", "Tj": "show", "'": "show_line", '"': "show_spaced", "TJ": "show_all",
    "m": "path_move", "l": "path_line", "re": "path_box", "S": "stroke", "s": "stroke", "B": "stroke", "f": "drop", "F": "drop", "n": "drop", "f*": "drop", "Do": "draw",
}


def write(pages: list[dict], width: float = 612, height: float = 792, compress: bool = True) -> bytes:
    """A file of pages with ``texts`` (x, y from the top, text), ``lines`` (x0, y0, x1, y1), ``boxes`` (x, y, w, h) and
    ``images`` (x, y from the top, width, height, columns, rows, gray bytes; a filter's name may follow)."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for p in pages:
        ops = [b"1 w"]
        for x, y, text in p.get("texts", ()):
            safe = text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
            ops.append(b"BT /F1 10 Tf %g %g Td (%s) Tj ET" % (x, height - y, safe))
        ops += [b"%g %g m %g %g l S" % (a, height - b, c, height - d) for a, b, c, d in p.get("lines", ())]
        ops += [b"%g %g %g %g re S" % (x, height - y - h, w, h) for x, y, w, h in p.get("boxes", ())]
        named = []
        for i, (x, y, w, h, columns, rows, data, *how) in enumerate(p.get("images", ())):
            objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 %s/Length %d >>\nstream\n%s\nendstream" % (columns, rows, b"/Filter /%s " % how[0] if how else b"", len(data), data))
            named.append(b"/I%d %d 0 R" % (i, len(objects)))
            ops.append(b"q %g 0 0 %g %g %g cm /I%d Do Q" % (w, h, x, height - y - h, i))
        body = b"\n".join(ops)
        body, how = (zlib.compress(body), b"/Filter /FlateDecode ") if compress else (body, b"")
        n = len(objects) + 1
        kids.append(b"%d 0 R" % n)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> /Contents %d 0 R >>" % (width, height, b" ".join(named), n + 1))
        objects.append(b"<< %s/Length %d >>\nstream\n%s\nendstream" % (how, len(body), body))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)
    return bytes(out)
