"""PDF pages: objects, page tree, content operators, text, and straight-edged drawing at 96 dpi.

Objects are indexed once a file. Operators are a table first (``operators``): drawing
and text are folds over it. Fills are even-odd, strokes are distances to segments,
clips are ignored, and text doesn't follow the transform. Glyph bitmaps are a
parameter, ``glyph(char) -> 8 rows of 8 bits`` (bit 0 is the left); by default every
visible character is a block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from pixelloom.sources.codecs import Image, image, need

SCALE = 96 / 72
SPACE = rb"[\0\t\n\f\r ]"
OBJECT = re.compile(rb"(?:^|(?<=[\0\t\n\f\r >]))(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
#: Code points outside ASCII that draw as an ASCII character, fixed values.
PLAIN = {0x2018: "'", 0x2019: "'", 0x2032: "'", 0x201C: '"', 0x201D: '"', 0x2033: '"', 0x2013: "-", 0x2014: "-", 0x2212: "-", 0xA0: " ", 0x2022: "*"}


def advance(c: str) -> float:
    """Width of a character in ems, a fixed table by class."""
    for chars, width in (("MW", 0.889), ("I", 0.333), ("m", 0.833), ("w", 0.722), ("il .,:;!'/", 0.278), ("()[]-", 0.333), ("?", 0.556)):
        if c in chars:
            return width
    return 0.556 if c.isdigit() else 0.667 if "A" <= c <= "Z" else 0.5


class File:
    def __init__(self, data: bytes):
        need(data[:5] == b"%PDF-", "invalid PDF header")
        end = data.rfind(b"%%EOF")
        need(end >= 0, "missing PDF EOF marker")
        need(b"startxref" in data[:end], "missing startxref")
        self.objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        root = re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", data)
        need(root, "missing PDF root")
        self.pages = list(self._leaves(self._ref(self.body(int(root[-1])), b"Pages"), set()))

    def body(self, number: int | None) -> bytes:
        return self.objects.get(number, b"")

    def _ref(self, body: bytes, name: bytes) -> int | None:
        m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(m[1]) if m else None

    def _unpack(self, body: bytes) -> None:
        raw = self.stream(body)
        first = re.search(rb"/First\s+(\d+)", body)
        if not first:
            return
        head = [int(v) for v in re.findall(rb"\d+", raw[: int(first[1])])]
        pairs = list(zip(head[::2], head[1::2]))
        for k, (number, at) in enumerate(pairs):
            stop = pairs[k + 1][1] if k + 1 < len(pairs) else len(raw)
            self.objects.setdefault(number, raw[int(first[1]) + at : int(first[1]) + stop])

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"\bstream\r?\n", body)
        if not m:
            return b""
        raw = body[m.end() : body.rfind(b"endstream")]
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: m.start()])
        raw = raw[: int(size[1])] if size and int(size[1]) <= len(raw) else raw.rstrip(b"\r\n")
        if b"FlateDecode" not in body[: m.start()]:
            return raw
        for bits in (15, -15):
            try:
                return zlib.decompressobj(bits).decompress(raw)
            except zlib.error:
                continue
        return b""

    def _leaves(self, number: int | None, seen: set[int], depth: int = 0) -> Iterator[int]:
        if number is None or number in seen or depth > 64:
            return
        seen.add(number)
        body = self.body(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and not re.search(rb"/Type\s*/Page\b(?!s)", body):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from self._leaves(int(k), seen, depth + 1)
        elif body:
            yield number

    def page(self, index: int) -> bytes:
        need(0 <= index < len(self.pages), "page index out of range")
        return self.body(self.pages[index])

    def size(self, index: int) -> tuple[float, float]:
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", self.page(index))
        v = [float(x) for x in re.findall(rb"[-+.\d]+", box[1])] if box else []
        w, h = (v[2] - v[0], v[3] - v[1]) if len(v) == 4 else (612, 792)
        return (w, h) if w > 0 and h > 0 else (612, 792)

    def content(self, index: int) -> bytes:
        body = self.page(index)
        many = re.search(rb"/Contents\s*\[(.*?)\]", body, re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", many[1]) if many else [str(self._ref(body, b"Contents") or 0).encode()]
        return b"\n".join(self.stream(self.body(int(r))) for r in refs)

    def fonts(self, index: int) -> dict[str, dict[bytes, int]]:
        """Code maps of the page's fonts from their ToUnicode streams."""
        body = self.page(index)
        resources = self.body(self._ref(body, b"Resources")) + body
        table = self.body(self._ref(resources, b"Font"))
        inline = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S)
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", table or (inline[1] if inline else b"")):
            cmap = self.stream(self.body(self._ref(self.body(int(number)), b"ToUnicode")))
            found[name.decode("latin-1")] = code_map(cmap)
        return found


def code_map(cmap: bytes) -> dict[bytes, int]:
    out: dict[bytes, int] = {}

    def point(h: bytes) -> int:
        return int(h[:4] or b"0", 16) if len(h) > 4 else int(h or b"0", 16)

    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for src, dst in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(src.decode())] = point(dst)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for k in range(low, high + 1):
                if one or k - low < len(listed):
                    out[k.to_bytes(len(a) // 2, "big")] = point(one) + k - low if one else point(listed[k - low])
    return out


TOKEN = re.compile(rb"%[^\r\n]*|(?P<num>[-+]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\()|(?P<mark>\[|\]|<<|>>)|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from just after the first."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at)
            if not m:
                break
            at, e = m.end(), m[0]
            out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else b"" if e in (b"\n", b"\r", b"\r\n") else ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def operators(content: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands): numbers, names as "/X", strings as bytes, arrays as lists."""
    args, stack, at = [], [], 0
    while at < len(content):
        m = TOKEN.match(content, at)
        if not m:
            at += 1
            continue
        at, value = m.end(), None
        if m["num"]:
            value = float(m["num"])
        elif m["name"] is not None:
            value = "/" + m["name"].decode("latin-1")
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m["open"]:
            value, at = literal(content, at)
        elif m["mark"] == b"[":
            stack.append(args)
            args = []
        elif m["mark"] == b"]" and stack:
            value, args = args, stack.pop()
        elif m["word"]:
            yield m["word"].decode("latin-1"), args[-64:]
            args = []
        if value is not None:
            args.append(value)


@dataclass
class Graphics:
    ctm: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    fill: tuple = (0, 0, 0)
    stroke: tuple = (0, 0, 0)
    width: float = 1.0


@dataclass
class Page:
    """The fold's state: where text stands, the path so far, and what to draw on."""

    rgba: np.ndarray | None
    height: float
    fonts: dict
    glyph: Callable[[str], bytes]
    gs: Graphics = field(default_factory=Graphics)
    stack: list = field(default_factory=list)
    path: list = field(default_factory=list)
    start: tuple | None = None
    here: tuple | None = None
    line: tuple = (0.0, 0.0)
    pen: tuple = (0.0, 0.0)
    size: float = 12.0
    leading: float = 0.0
    font: dict | None = None
    inside: bool = False
    said: list = field(default_factory=list)

    def move_line(self, x: float, y: float) -> None:
        self.line = self.pen = (x, y)

    def next_line(self) -> None:
        self.move_line(self.line[0], self.line[1] - (self.leading if self.leading > 0 else self.size * 1.2))
        self.said.append("\n")

    def show(self, raw: bytes) -> None:
        if not self.inside:
            return
        at = 0
        while at < len(raw):
            take = next((n for n in range(min(4, len(raw) - at), 0, -1) if raw[at : at + n] in (self.font or {})), 0)
            point = self.font[raw[at : at + take]] if take else raw[at]
            at += take or 1
            if point in (10, 13):
                self.next_line()
                continue
            if point < 32:
                continue
            c = chr(point) if point < 128 else PLAIN.get(point, "?")
            self.said.append(chr(point))
            if c != " ":
                self.draw_glyph(c)
            self.pen = (self.pen[0] + self.size * (0.5 if c == "?" and point >= 128 else advance(c)), self.pen[1])

    def draw_glyph(self, c: str) -> None:
        if self.rgba is None:
            return
        px = max(6.0, self.size * SCALE)
        sx, sy = max(1, int(px * 0.6 / 8 + 0.5)), max(1, int(px / 8 + 0.5))
        x, y = int(self.pen[0] * SCALE + 0.5), int((self.height - self.pen[1]) * SCALE + 0.5) - int(px + 0.5)
        for gy, row in enumerate(self.glyph(c)):
            for gx in range(8):
                if row >> gx & 1:
                    a, b = y + gy * sy, x + gx * sx
                    self.rgba[max(0, a) : max(0, a + sy), max(0, b) : max(0, b + sx)] = (*self.gs.fill, 255)

    def segments(self) -> np.ndarray:
        """Path segments (n, 4) in pixels."""
        a, b, c, d, e, f = self.gs.ctm
        p = np.array(self.path, float).reshape(-1, 2)
        x, y = a * p[:, 0] + c * p[:, 1] + e, b * p[:, 0] + d * p[:, 1] + f
        return np.column_stack([x * SCALE, (self.height - y) * SCALE]).reshape(-1, 4)

    def paint(self, fill: bool, stroke: bool) -> None:
        if self.rgba is not None and self.path:
            s = self.segments()
            if fill:
                self.fill_even_odd(s)
            if stroke:
                self.stroke_segments(s)
        self.path, self.start, self.here = [], None, None

    def fill_even_odd(self, s: np.ndarray) -> None:
        h, w = self.rgba.shape[:2]
        top, low = max(0, int(np.floor(s[:, [1, 3]].min()))), min(h, int(np.ceil(s[:, [1, 3]].max())))
        x = np.arange(w) + 0.5
        for y in range(top, low):
            at = y + 0.5
            x0, y0, x1, y1 = s[((s[:, 1] < at) & (s[:, 3] >= at)) | ((s[:, 3] < at) & (s[:, 1] >= at))].T
            flat = abs(y0 - y1) <= 1e-6
            cross = np.sort((x0 + (at - y0) / np.where(flat, 1, y1 - y0) * (x1 - x0))[~flat])
            odd = (len(cross) - np.searchsorted(cross, x, "right")) % 2 == 1
            self.rgba[y, odd] = (*self.gs.fill, 255)

    def stroke_segments(self, s: np.ndarray) -> None:
        h, w = self.rgba.shape[:2]
        half = max(0.5, self.gs.width * SCALE / 2)
        for x0, y0, x1, y1 in s:
            a, b = max(0, int(np.floor(min(x0, x1) - half - 1))), min(w - 1, int(np.ceil(max(x0, x1) + half + 1)))
            c, d = max(0, int(np.floor(min(y0, y1) - half - 1))), min(h - 1, int(np.ceil(max(y0, y1) + half + 1)))
            if a > b or c > d:
                continue
            py, px = np.mgrid[c : d + 1, a : b + 1] + 0.5
            vx, vy = x1 - x0, y1 - y0
            size = vx * vx + vy * vy
            t = np.clip(((px - x0) * vx + (py - y0) * vy) / size, 0, 1) if size > 1e-8 else 0.0
            near = (px - x0 - t * vx) ** 2 + (py - y0 - t * vy) ** 2 <= half * half
            self.rgba[c : d + 1, a : b + 1][near] = (*self.gs.stroke, 255)

    def edge(self, to: tuple) -> None:
        if self.here is not None:
            self.path.append((*self.here, *to))
        self.here = to

    def close(self) -> None:
        if self.start is not None and self.here != self.start:
            self.edge(self.start)

    def run(self, op: str, args: list) -> None:
        n = [v for v in args if isinstance(v, float)]
        last = args[-1] if args else None
        if op in ("rg", "RG", "g", "G"):
            need_n = 3 if op in ("rg", "RG") else 1
            if len(n) >= need_n:
                v = tuple(min(255, max(0, int(c * 255 + 0.5))) for c in n[-need_n:]) * (3 // need_n)
                self.gs = replace(self.gs, **{"fill" if op.islower() else "stroke": v})
        elif op == "w" and n and 0 < n[-1] < 1000:
            self.gs = replace(self.gs, width=n[-1])
        elif op == "cm" and len(n) >= 6:
            a, b, c, d, e, f = n[-6:]
            p, q, r, s, t, u = self.gs.ctm
            self.gs = replace(self.gs, ctm=(a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f))
        elif op == "q":
            self.stack.append(self.gs)
        elif op == "Q" and self.stack:
            self.gs = self.stack.pop()
        elif op == "m" and len(n) >= 2:
            self.start = self.here = tuple(n[-2:])
        elif op == "l" and len(n) >= 2:
            self.edge(tuple(n[-2:]))
        elif op == "h":
            self.close()
        elif op == "re" and len(n) >= 4:
            x, y, w, h = n[-4:]
            self.start = self.here = (x, y)
            for to in ((x + w, y), (x + w, y + h), (x, y + h), (x, y)):
                self.edge(to)
        elif op in ("n", "S", "s", "f", "f*", "B", "B*", "b", "b*"):
            if op in ("s", "b", "b*"):
                self.close()
            self.paint(op[0] in "fBb", op[0] in "SsBb")
        elif op == "BT":
            self.inside = True
            self.move_line(0.0, 0.0)
        elif op == "ET":
            self.inside = False
            self.said.append("\n")
        elif op == "Tf" and len(args) >= 2 and n:
            self.font = self.fonts.get(str(args[-2]).lstrip("/"))
            self.size = n[-1] if 0.1 < n[-1] < 500 else self.size
        elif op in ("Td", "TD") and len(n) >= 2:
            if op == "TD":
                self.leading = -n[-1]
            self.move_line(self.line[0] + n[-2], self.line[1] + n[-1])
            self.said.append("\n" if n[-1] else "")
        elif op == "Tm" and len(n) >= 6:
            self.move_line(n[-2], n[-1])
        elif op == "TL" and n:
            self.leading = n[-1]
        elif op == "T*":
            self.next_line()
        elif op in ("Tj", "'", '"') and isinstance(last, bytes):
            if op != "Tj":
                self.next_line()
            self.show(last)
        elif op == "TJ" and isinstance(last, list):
            for v in last:
                if isinstance(v, bytes):
                    self.show(v)
                elif isinstance(v, float):
                    self.pen = (self.pen[0] - v / 1000 * self.size, self.pen[1])


def block(c: str) -> bytes:
    return b"\x7e" * 7 + b"\0"


def folded(f: File, index: int, rgba: np.ndarray | None, glyph) -> Page:
    page = Page(rgba, f.size(index)[1], f.fonts(index), glyph)
    for op, args in operators(f.content(index)):
        page.run(op, args)
    return page


def page_count(data: bytes) -> int:
    return len(File(data).pages)


def text(data: bytes, index: int = 0) -> str:
    """What a page says, in drawing order."""
    return re.sub(r"\n+", "\n", "".join(folded(File(data), index, None, block).said)).strip("\n")


def decode(data: bytes, index: int = 0, *, trim: bool = True, glyph=block) -> Image:
    """A page on white."""
    f = File(data)
    w, h = f.size(index)
    rgba = np.full((max(1, int(h * SCALE + 0.5)), max(1, int(w * SCALE + 0.5)), 4), 255, np.uint8)
    folded(f, index, rgba, glyph)
    return image(trimmed(rgba) if trim else rgba)


def trimmed(rgba: np.ndarray, share: int = 300, pad: int = 16) -> np.ndarray:
    """Cut edges that hold at most 1/share of the ink a side, a sixth at most, with padding."""
    ink = (rgba[..., :3] < 250).any(2)
    if not ink.any():
        return rgba
    cuts = []
    for mass in (ink.sum(1), ink.sum(0)):
        most = int(mass.sum()) // share
        low = int(np.searchsorted(np.cumsum(mass), most, "right"))
        high = len(mass) - 1 - int(np.searchsorted(np.cumsum(mass[::-1]), most, "right"))
        sixth = len(mass) // 6
        low, high = min(low, sixth), max(high, len(mass) - 1 - sixth)
        cuts.append((max(0, low - pad), min(len(mass) - 1, high + pad)))
    (top, bottom), (left, right) = cuts
    if bottom - top + 1 >= rgba.shape[0] or right - left + 1 >= rgba.shape[1]:
        return rgba
    return rgba[top : bottom + 1, left : right + 1]
