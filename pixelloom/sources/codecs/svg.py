"""SVG: shapes, paths, groups, use, CSS, gradients, patterns, clips, masks, animation at one time.

Documents become a tree, styles are resolved by cascade, shapes flatten to polylines,
and a polyline is filled or stroked on a supersampled premultiplied canvas that is
averaged at the end. Nothing outside the document is read but data URIs. Text is
drawn with glyph bitmaps that are a parameter, as for PDF.
"""

from __future__ import annotations

import base64
import colorsys
import math
import re
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import numpy as np

from pixelloom.functions.svg import NUMBER, named_colors
from pixelloom.sources.codecs import Image, ImageError, image, need
from pixelloom.sources.codecs.pdf import block

TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[?!][^>]*>|<(?P<end>/)?(?P<name>[^\s/>]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/)?>|(?P<text>[^<]+)", re.S)
ATTR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
NUMBERS = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
INHERITED = {"fill", "fill-opacity", "fill-rule", "stroke", "stroke-width", "stroke-opacity", "stroke-linecap", "stroke-linejoin", "stroke-miterlimit",
             "stroke-dasharray", "stroke-dashoffset", "font-size", "text-anchor", "visibility", "color", "clip-rule"}
PROPERTIES = INHERITED | {"opacity", "display", "clip-path", "mask", "mask-type", "stop-color", "stop-opacity", "transform"}
DEPTH = 64
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: Node | None = None
    children: list = field(default_factory=list)
    text: str = ""
    style: dict = field(default_factory=dict)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def decoded(s: str) -> str:
    def one(m):
        k = m[1]
        if k.startswith("#"):
            try:
                return chr(int(k[2:], 16) if k[1:2] in "xX" else int(k[1:]))
            except ValueError:
                return "?"
        return ENTITIES.get(k, m[0])

    return re.sub(r"&(#?\w+);", one, s)


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def parse(data: bytes) -> Node:
    """The document's svg element; names without their prefix."""
    text = data.decode("utf-8", "replace").lstrip("﻿")
    root, here = None, None
    for m in TAG.finditer(text):
        if m["name"] is None:
            if here is not None:
                here.text += m["cdata"] or (decoded(m["text"]) if m["text"] else "")
            continue
        name = local(m["name"]).lower()
        if m["end"]:
            while here is not None and here.tag != name and here.parent is not None:
                here = here.parent
            here = here.parent if here is not None and here.parent is not None else here
            continue
        if root is None and name != "svg":
            continue
        attrs = {local(k): decoded(a if a else b) for k, a, b in ATTR.findall(m["attrs"])}
        node = Node(name, attrs, here)
        if root is None:
            root = node
        else:
            here.children.append(node)
        if not m["self"]:
            here = node
        elif here is None:
            here = node
    need(root is not None, "missing SVG root")
    return root


def numbers(s: str | None) -> list[float]:
    return [float(v) for v in NUMBERS.findall(s or "")]


def length(s: str | None, base: float = 0.0, dpi: float = 96.0, default: float = 0.0) -> float:
    m = re.match(rf"\s*{NUMBER}\s*(%|px|pt|pc|in|cm|mm)?", s or "")
    if not m:
        return default
    unit = {"pt": dpi / 72, "pc": dpi / 6, "in": dpi, "cm": dpi / 2.54, "mm": dpi / 25.4, "%": base / 100}.get(m[2], 1.0)
    return float(m[1]) * unit


def fraction(s: str | None, default: float = 1.0) -> float:
    m = re.match(rf"\s*{NUMBER}\s*(%?)", s or "")
    return min(1.0, max(0.0, float(m[1]) / (100 if m[2] else 1))) if m else default


def color(s: str | None) -> tuple[int, int, int, int] | None:
    """rgba, or None for none and what doesn't parse."""
    s = (s or "").strip().lower()
    if re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", s):
        h = s[1:] if len(s) > 5 else "".join(2 * c for c in s[1:])
        return tuple(int((h + "ff")[k : k + 2], 16) for k in (0, 2, 4, 6))
    m = re.match(r"(rgb|hsl)a?\(([^)]*)", s)
    if m:
        parts = re.findall(rf"{NUMBER}\s*(%|deg|grad|rad|turn)?", m[2])
        if len(parts) < 3:
            return None
        v = [float(p[0]) for p in parts]
        alpha = 1.0 if len(v) < 4 else v[3] / 100 if parts[3][1] == "%" else v[3] if v[3] <= 1 else v[3] / 255
        if m[1] == "rgb":
            rgb = [x * (2.55 if p[1] == "%" else 1) for x, p in zip(v[:3], parts)]
        else:
            hue = v[0] * {"grad": 0.9, "rad": 180 / math.pi, "turn": 360}.get(parts[0][1], 1) / 360 % 1
            sat, light = (min(1.0, max(0.0, x / 100 if p[1] == "%" or x > 1 else x)) for x, p in zip(v[1:3], parts[1:3]))
            rgb = [c * 255 for c in colorsys.hls_to_rgb(hue, light, sat)]
        return (*(int(min(255, max(0, c)) + 0.5) for c in rgb), int(min(1, max(0, alpha)) * 255 + 0.5))
    name = named_colors().get(s)
    return tuple(bytes.fromhex(name)) if name else None


def multiply(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def transform(s: str | None) -> tuple:
    out = IDENTITY
    for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", s or ""):
        v, name = numbers(inner), name.lower()
        if not v:
            continue
        if name == "matrix" and len(v) >= 6:
            m = tuple(v[:6])
        elif name == "translate":
            m = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif name == "scale":
            m = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif name == "rotate":
            c, w = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m = (c, w, -w, c, 0, 0)
            if len(v) > 2:
                m = multiply(multiply((1, 0, 0, 1, v[1], v[2]), m), (1, 0, 0, 1, -v[1], -v[2]))
        elif name in ("skewx", "skewy"):
            k = math.tan(math.radians(v[0]))
            m = (1, 0, k, 1, 0, 0) if name == "skewx" else (1, k, 0, 1, 0, 0)
        else:
            continue
        out = multiply(out, m)
    return out


def declarations(s: str | None) -> dict:
    pairs = (d.split(":", 1) for d in re.sub(r"/\*.*?\*/", "", s or "", flags=re.S).split(";") if ":" in d)
    return {k.strip().lower(): v.replace("!important", "").strip() for k, v in pairs}


@dataclass
class Rule:
    specificity: int
    order: int
    chain: list  # [(combinator, simple selector)], from the element outwards
    values: dict


def rules_of(root: Node) -> list[Rule]:
    css = "\n".join(n.text for n in root.walk() if n.tag == "style")
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    css = re.sub(r"@[\w-]+[^{;]*(?:\{(?:[^{}]|\{[^}]*\})*\}|;)", "", css)
    out = []
    for selectors, body in re.findall(r"([^{}]+)\{([^}]*)\}", css):
        for s in selectors.split(","):
            parts = re.findall(r"\s*([>+~])\s*|(\s+)|([^\s>+~]+)", s.strip())
            chain, comb = [], ""
            for mark, gap, simple in parts:
                if simple:
                    chain.append((comb, simple))
                    comb = ""
                else:
                    comb = mark or comb or " "
            if chain:
                spec = sum(100 * p.count("#") + 10 * (p.count(".") + p.count("[")) + bool(re.match(r"[\w-]", p)) for _, p in chain)
                out.append(Rule(spec, len(out), chain[::-1], declarations(body)))
    return out


def simple_match(n: Node, s: str) -> bool:
    name = re.match(r"\*|[\w-]+", s)
    if name and name[0] not in ("*",) and name[0].lower() != n.tag:
        return False
    for kind, word in re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^\]]*\]", "", s)):
        if (word not in n.attrs.get("class", "").split()) if kind == "." else n.attrs.get("id") != word:
            return False
    for key, _, value in re.findall(r"\[\s*([\w-]+)\s*(=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]", s):
        if key not in n.attrs or _ and n.attrs[key] != value:
            return False
    return True


def matches(n: Node | None, chain: list) -> bool:
    if n is None or not simple_match(n, chain[0][1]):
        return False
    if len(chain) == 1:
        return True
    comb, rest = chain[0][0], chain[1:]
    before = n.parent.children[: next(k for k, c in enumerate(n.parent.children) if c is n)] if n.parent else []
    if comb == ">":
        return matches(n.parent, rest)
    if comb == "+":
        return bool(before) and matches(before[-1], rest)
    if comb == "~":
        return any(matches(b, rest) for b in before)
    up = n.parent
    while up is not None:
        if matches(up, rest):
            return True
        up = up.parent
    return False


def resolve(n: Node, inherited: dict, rules: list[Rule]) -> None:
    """Attributes, then rules by specificity and order, then the style attribute."""
    own = {k: v for k, v in n.attrs.items() if k in PROPERTIES}
    for r in sorted((r for r in rules if matches(n, r.chain)), key=lambda r: (r.specificity, r.order)):
        own |= r.values
    own |= declarations(n.attrs.get("style"))
    n.style = {k: inherited[k] for k in INHERITED & inherited.keys()} | {k: v for k, v in own.items() if v != "inherit"}
    for c in n.children:
        resolve(c, n.style, rules)


def keyframes_of(root: Node) -> dict[str, list[tuple[float, dict]]]:
    """Steps (offset, declarations) of each @keyframes, by name, in order of offset."""
    css = re.sub(r"/\*.*?\*/", "", "\n".join(n.text for n in root.walk() if n.tag == "style"), flags=re.S)
    out = {}
    for name, body in re.findall(r"@(?:-webkit-)?keyframes\s+([\w-]+)\s*\{((?:[^{}]|\{[^}]*\})*)\}", css):
        steps = []
        for places, values in re.findall(r"([^{}]+)\{([^}]*)\}", body):
            for place in places.split(","):
                at = {"from": 0.0, "to": 1.0}.get(place.strip().lower())
                steps.append((at if at is not None else fraction(place, 0.0), declarations(values)))
        out[name] = sorted(steps, key=lambda s: s[0])
    return out


def css_animated(n: Node, frames: dict, t: float) -> None:
    """Put what an ``animation`` gives at time ``t`` into the node's style."""
    words = re.sub(r"\([^)]*\)", "", n.style.get("animation", "")).split()
    steps = next((frames[w] for w in words if w in frames), None)
    clocks = [c for w in words if re.search(r"\d\s*m?s$", w.lower()) and (c := clock(w)) is not None]
    if not steps or not clocks or clocks[0] <= 0:
        return
    dur, delay = clocks[0], clocks[1] if len(clocks) > 1 else 0.0
    times = math.inf if "infinite" in words else next((float(w) for w in words if re.fullmatch(r"\d+\.?\d*|\.\d+", w) and float(w) > 0), 1.0)
    fill, at = {"forwards", "backwards", "both"} & set(words), t - delay
    if at < 0:
        if not fill & {"backwards", "both"}:
            return
        cycle, phase = 0, 0.0
    elif at < dur * times:
        cycle, phase = int(at // dur), at % dur / dur
    else:
        if not fill & {"forwards", "both"}:
            return
        cycle = max(0, math.ceil(times) - 1)
        phase = times - cycle
    back = "reverse" in words or ("alternate" in words and cycle % 2 == 1) or ("alternate-reverse" in words and cycle % 2 == 0)
    u = 1 - phase if back else phase
    for name in {k for _, d in steps for k in d}:
        known = [(o, d[name]) for o, d in steps if name in d]
        k = next((j for j in range(len(known) - 1) if known[j][0] <= u <= known[j + 1][0]), None)
        if k is None:
            n.style[name] = known[0][1] if u <= known[0][0] else known[-1][1]
            continue
        (o0, low), (o1, high) = known[k], known[k + 1]
        n.style[name] = halfway(low, high, (u - o0) / (o1 - o0) if o1 > o0 else 0.0)


def halfway(low: str, high: str, u: float) -> str:
    """Between two colours, or two texts that differ in their numbers."""
    if color(low) and color(high):
        return "#" + "".join(f"{int(p + (q - p) * u + 0.5):02x}" for p, q in zip(color(low), color(high)))
    a, b = numbers(low), numbers(high)
    if len(a) != len(b) or NUMBERS.sub("", low) != NUMBERS.sub("", high):
        return low if u < 0.5 else high
    values = iter(f"{p + (q - p) * u:.9g}" for p, q in zip(a, b))
    return NUMBERS.sub(lambda m: next(values), low)


def clock(s: str | None, default: float | None = None) -> float | None:
    m = re.fullmatch(rf"\s*{NUMBER}\s*([mM][sS]|s|m|h)?\s*", (s or "").split(";")[0])
    return float(m[1]) * {"ms": 0.001, "m": 60, "h": 3600}.get((m[2] or "s").lower(), 1) if m else default


def progress(a: Node, t: float) -> float | None:
    dur = clock(a.attrs.get("dur"))
    if not dur or dur <= 0:
        return None
    at = t - (clock(a.attrs.get("begin"), 0.0) or 0.0)
    if at < 0:
        return None
    count = a.attrs.get("repeatCount", "1").strip()
    times = math.inf if count.lower() == "indefinite" else float(count) if re.fullmatch(NUMBER, count) and float(count) > 0 else 1.0
    if at >= dur * times:
        return 1.0 if a.attrs.get("fill", "").lower() == "freeze" else None
    return at % dur / dur


def animated(n: Node, t: float) -> None:
    """Write the values that set, animate and animateTransform give at time ``t`` into attributes."""
    for a in n.children:
        if a.tag not in ("set", "animate", "animatetransform"):
            continue
        name = a.attrs.get("attributeName", "")
        if a.tag == "set":
            begin, dur = clock(a.attrs.get("begin"), 0.0), clock(a.attrs.get("dur"))
            if t >= begin and (dur is None or t < begin + dur or a.attrs.get("fill") == "freeze"):
                n.attrs[name] = a.attrs.get("to", "")
            continue
        u = progress(a, t)
        if u is None:
            continue
        steps = [v.strip() for v in a.attrs.get("values", "").split(";") if v.strip()]
        if not steps:
            start = a.attrs.get("from") or n.attrs.get(name, "0")
            by = numbers(a.attrs.get("by"))
            steps = [start, a.attrs.get("to") or " ".join(str(p + q) for p, q in zip(numbers(start), by))]
        k = min(int(u * (len(steps) - 1)), max(0, len(steps) - 2))
        low, high, v = steps[k], steps[min(k + 1, len(steps) - 1)], u * (len(steps) - 1) - k
        if a.attrs.get("calcMode") == "discrete":
            value = steps[min(int(u * len(steps)), len(steps) - 1)]
        elif color(low) and color(high):
            value = "#" + "".join(f"{int(p + (q - p) * v + 0.5):02x}" for p, q in zip(color(low), color(high)))
        else:
            value = " ".join(f"{p + (q - p) * v:.9g}" for p, q in zip(numbers(low), numbers(high))) or low
        n.attrs["transform" if a.tag == "animatetransform" else name] = f"{a.attrs.get('type', 'translate')}({value})" if a.tag == "animatetransform" else value


def arc(x0, y0, rx, ry, turn, large, sweep, x1, y1) -> list:
    """Points of an elliptical arc by its end points."""
    rx, ry = abs(rx), abs(ry)
    if not rx or not ry or (x0, y0) == (x1, y1):
        return [(x1, y1)]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    dx, dy = (x0 - x1) / 2, (y0 - y1) / 2
    px, py = c * dx + s * dy, c * dy - s * dx
    grow = math.sqrt(max(1.0, (px / rx) ** 2 + (py / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    left = max(0.0, (rx * ry) ** 2 - (rx * py) ** 2 - (ry * px) ** 2) / ((rx * py) ** 2 + (ry * px) ** 2)
    k = math.sqrt(left) * (-1 if large == sweep else 1)
    cx, cy = k * rx * py / ry, -k * ry * px / rx
    a0, a1 = math.atan2((py - cy) / ry, (px - cx) / rx), math.atan2((-py - cy) / ry, (-px - cx) / rx)
    span = a1 - a0 + (2 * math.pi if sweep and a1 < a0 else -2 * math.pi if not sweep and a1 > a0 else 0)
    mx, my = c * cx - s * cy + (x0 + x1) / 2, s * cx + c * cy + (y0 + y1) / 2
    n = max(2, math.ceil(abs(span) / (math.pi / 24)))
    out = []
    for j in range(1, n + 1):
        a = a0 + span * j / n
        out.append((mx + c * rx * math.cos(a) - s * ry * math.sin(a), my + s * rx * math.cos(a) + c * ry * math.sin(a)))
    return out[:-1] + [(x1, y1)]


def curve(p: list, n: int = 24) -> list:
    """Points of a Bezier curve of two or three degrees, without its first."""
    t = np.linspace(0, 1, n + 1)[1:, None]
    pts = np.array(p, float)
    if len(p) == 3:
        out = (1 - t) ** 2 * pts[0] + 2 * t * (1 - t) * pts[1] + t**2 * pts[2]
    else:
        out = (1 - t) ** 3 * pts[0] + 3 * t * (1 - t) ** 2 * pts[1] + 3 * t**2 * (1 - t) * pts[2] + t**3 * pts[3]
    return [tuple(v) for v in out.tolist()]


def path(d: str) -> list[tuple[list, bool]]:
    """Subpaths as (points, closed)."""
    out, pts, here, start, ctrl, last = [], [], (0.0, 0.0), (0.0, 0.0), None, ""
    counts = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    for op, args in re.findall(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)", d or ""):
        up = op.upper()
        if up == "A":
            flags = re.findall(rf"{NUMBER}[\s,]*{NUMBER}[\s,]*{NUMBER}[\s,]*([01])[\s,]*([01])[\s,]*{NUMBER}[\s,]*{NUMBER}", args)
            v = [float(x) for f in flags for x in f]
        else:
            v = numbers(args)
        n = counts[up]
        if up == "Z":
            if pts:
                out.append((pts, True))
            pts, here, last = [], start, "Z"
            continue
        for k in range(0, len(v) - n + 1, n):
            a = v[k : k + n]
            if op.islower():
                if up == "H":
                    a = [a[0] + here[0]]
                elif up == "V":
                    a = [a[0] + here[1]]
                elif up == "A":
                    a = a[:5] + [a[5] + here[0], a[6] + here[1]]
                else:
                    a = [x + here[j % 2] for j, x in enumerate(a)]
            if up == "M" and k == 0:
                if len(pts) > 1:
                    out.append((pts, False))
                here = start = (a[0], a[1])
                pts, last = [here], "M"
                continue
            if not pts:
                pts = [here]
            pairs = [tuple(a[j : j + 2]) for j in range(0, len(a) - 1, 2)]
            mirror = (2 * here[0] - ctrl[0], 2 * here[1] - ctrl[1]) if ctrl else here
            if up == "H":
                new, ctrl = [(a[0], here[1])], None
            elif up == "V":
                new, ctrl = [(here[0], a[0])], None
            elif up == "C":
                new, ctrl = curve([here, *pairs]), pairs[1]
            elif up == "S":
                new, ctrl = curve([here, mirror if last in "CS" else here, *pairs]), pairs[0]
            elif up == "Q":
                new, ctrl = curve([here, *pairs]), pairs[0]
            elif up == "T":
                ctrl = mirror if last in "QT" else here
                new = curve([here, ctrl, pairs[0]])
            elif up == "A":
                new, ctrl = arc(*here, a[0], a[1], a[2], a[3] == 1, a[4] == 1, a[5], a[6]), None
            else:
                new, ctrl = [pairs[0]], None
            pts += new
            here, last = pts[-1], up
    if len(pts) > 1:
        out.append((pts, False))
    return out


def outline(n: Node, w: float, h: float) -> list[tuple[list, bool]]:
    """A shape's subpaths in user space."""
    def get(k, base=0.0):
        return length(n.attrs.get(k), base)

    if n.tag == "rect":
        x, y, rw, rh = get("x", w), get("y", h), get("width", w), get("height", h)
        rx = get("rx", w) if "rx" in n.attrs else get("ry", h)
        ry = get("ry", h) if "ry" in n.attrs else rx
        rx, ry = min(rx, rw / 2), min(ry, rh / 2)
        if rw <= 0 or rh <= 0:
            return []
        if rx <= 0 or ry <= 0:
            return [([(x, y), (x + rw, y), (x + rw, y + rh), (x, y + rh)], True)]
        a = f"A{rx} {ry} 0 0 1 "
        return path(f"M{x + rx} {y}H{x + rw - rx}{a}{x + rw} {y + ry}V{y + rh - ry}{a}{x + rw - rx} {y + rh}H{x + rx}{a}{x} {y + rh - ry}V{y + ry}{a}{x + rx} {y}Z")
    if n.tag in ("circle", "ellipse"):
        cx, cy = get("cx", w), get("cy", h)
        rx, ry = (get("r", (w + h) / 2),) * 2 if n.tag == "circle" else (get("rx", w), get("ry", h))
        a = np.linspace(0, 2 * math.pi, 97)[:-1]
        return [(list(zip((cx + rx * np.cos(a)).tolist(), (cy + ry * np.sin(a)).tolist())), True)] if rx > 0 and ry > 0 else []
    if n.tag == "line":
        return [([(get("x1", w), get("y1", h)), (get("x2", w), get("y2", h))], False)]
    if n.tag in ("polyline", "polygon"):
        v = numbers(n.attrs.get("points"))
        pts = list(zip(v[::2], v[1::2]))
        return [(pts, n.tag == "polygon")] if len(pts) > 1 else []
    return path(n.attrs.get("d", "")) if n.tag == "path" else []


def coverage(lines: list[tuple[np.ndarray, bool]], shape: tuple[int, int], even_odd: bool) -> np.ndarray:
    """Sample centres inside the outlines (h, w)."""
    h, w = shape
    out = np.zeros(shape, bool)
    segs = [np.hstack([p, np.roll(p, -1, 0)]) for p, _ in lines if len(p) > 1]
    if not segs:
        return out
    s = np.concatenate(segs)
    top, low = max(0, int(np.floor(s[:, [1, 3]].min()))), min(h, int(np.ceil(s[:, [1, 3]].max())) + 1)
    x = np.arange(w) + 0.5
    for y in range(top, low):
        at = y + 0.5
        hit = s[(s[:, 1] <= at) != (s[:, 3] <= at)]
        if not len(hit):
            continue
        cross = hit[:, 0] + (at - hit[:, 1]) / (hit[:, 3] - hit[:, 1]) * (hit[:, 2] - hit[:, 0])
        way = np.where(hit[:, 3] > hit[:, 1], 1, -1)
        order = np.argsort(cross)
        sums = np.concatenate([[0], np.cumsum(way[order])])
        wind = sums[np.searchsorted(cross[order], x)]
        count = np.searchsorted(cross[order], x)
        out[y] = count % 2 == 1 if even_odd else wind != 0
    return out


def dashed(pts: list, closed: bool, dashes: list[float], shift: float) -> list[tuple[list, bool]]:
    if not dashes or sum(dashes) <= 0:
        return [(pts, closed)]
    dashes = dashes * (1 + len(dashes) % 2)
    pts = pts + [pts[0]] if closed else pts
    at, k = shift % sum(dashes), 0
    while at >= dashes[k]:
        at -= dashes[k]
        k = (k + 1) % len(dashes)
    left, out, now = dashes[k] - at, [], [pts[0]] if k % 2 == 0 else []
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        size, done = math.hypot(x1 - x0, y1 - y0), 0.0
        while size - done > left:
            done += left
            p = (x0 + (x1 - x0) * done / size, y0 + (y1 - y0) * done / size)
            if k % 2 == 0:
                out.append((now + [p], False))
            now = [p] if k % 2 else []
            k = (k + 1) % len(dashes)
            left = dashes[k] or 1e-9
        left -= size - done
        if k % 2 == 0:
            now.append((x1, y1))
    return out + ([(now, False)] if k % 2 == 0 and len(now) > 1 else [])


def stroke_outlines(lines: list[tuple[list, bool]], width: float, cap: str, join: str, limit: float) -> list[np.ndarray]:
    """Polygons in user space that together make the stroke."""
    half, out = width / 2, []
    circle = np.linspace(0, 2 * math.pi, 33)[:-1]
    disc = np.column_stack([np.cos(circle), np.sin(circle)]) * half
    for pts, closed in lines:
        p = [np.array(v, float) for k, v in enumerate(pts) if not k or v != pts[k - 1]]
        if closed and len(p) > 2:
            p = p + [p[0]] if (p[0] != p[-1]).any() else p
        if len(p) < 2:
            continue
        units = [(b - a) / np.linalg.norm(b - a) for a, b in zip(p, p[1:])]
        for k, (a, b, u) in enumerate(zip(p, p[1:], units)):
            n = np.array([-u[1], u[0]]) * half
            if cap == "square" and not closed:
                a = a - u * half if k == 0 else a
                b = b + u * half if k == len(units) - 1 else b
            out.append(np.array([a + n, b + n, b - n, a - n]))
        if cap == "round" and not closed:
            out += [disc + p[0], disc + p[-1]]
        joints = list(zip(units, units[1:], p[1:])) + ([(units[-1], units[0], p[0])] if closed and len(units) > 1 else [])
        for u, v, at in joints:
            turn = u[0] * v[1] - u[1] * v[0]
            if abs(turn) < 1e-9 and u @ v > 0:
                continue
            if join == "round":
                out.append(disc + at)
                continue
            side = -1 if turn > 0 else 1
            a, b = at + side * half * np.array([-u[1], u[0]]), at + side * half * np.array([-v[1], v[0]])
            corner = [at, a, b]
            cosine = float(np.clip(u @ v, -1, 1))
            reach = 1 / max(1e-6, math.sqrt((1 + cosine) / 2))
            if join == "miter" and reach <= limit:
                tip = a + b - 2 * at
                corner = [at, a, at + tip / max(1e-9, np.linalg.norm(tip)) * half * reach, b]
            out.append(np.array(corner))
    return out


class Canvas:
    def __init__(self, width: int, height: int, ss: int, background: int):
        self.ss = ss
        a = background
        self.px = np.zeros((height * ss, width * ss, 4), np.int64)
        self.px[:] = (255 * a // 255,) * 3 + (a,)

    def blend(self, mask: np.ndarray, rgba: np.ndarray, cover: np.ndarray | None = None) -> None:
        """Straight (h, w, 4) or one straight colour over the masked samples, scaled by ``cover`` in 0..1."""
        if cover is not None:
            mask = mask & (cover > 0)
        src = np.broadcast_to(np.asarray(rgba, np.int64), (*mask.shape, 4))[mask]
        a = src[:, 3:] if cover is None else np.floor(src[:, 3:] * cover[mask][:, None] + 0.5).astype(np.int64)
        self.px[mask] = np.concatenate([src[:, :3] * a // 255, a], 1) + self.px[mask] * (255 - a) // 255

    def resolved(self) -> np.ndarray:
        h, w = self.px.shape[:2]
        s = self.ss
        mean = self.px.reshape(h // s, s, w // s, s, 4).sum((1, 3)) // (s * s)
        a = mean[..., 3:]
        return np.concatenate([np.where(a > 0, mean[..., :3] * 255 // np.maximum(a, 1), 0) & 255, a], 2).astype(np.uint8)


class Renderer:
    def __init__(self, root: Node, canvas: Canvas, size: tuple[float, float], glyph):
        self.canvas, self.size, self.glyph = canvas, size, glyph
        self.ids = {n.attrs["id"]: n for n in root.walk() if "id" in n.attrs}

    def ref(self, s: str | None) -> Node | None:
        m = re.search(r"#([^)\"']+)", s or "")
        return self.ids.get(m[1].strip()) if m else None

    def draw(self, n: Node, m: tuple, opacity: float, clip: np.ndarray | None, style: dict | None = None, depth: int = 0) -> None:
        st = style or n.style
        if depth > DEPTH or st.get("display") == "none" or n.tag in ("defs", "symbol", "clippath", "mask", "marker", "lineargradient", "radialgradient", "pattern", "filter", "style", "title", "desc", "metadata"):
            return
        m = multiply(m, transform(st.get("transform") or n.attrs.get("transform")))
        opacity *= fraction(st.get("opacity"))
        ref = self.ref(st.get("clip-path"))
        if ref is not None and ref.tag == "clippath":
            shapes = [(c, multiply(m, transform(c.attrs.get("transform")))) for c in ref.children]
            area = np.zeros(self.canvas.px.shape[:2], bool)
            for c, cm in shapes:
                area |= coverage(self.placed(outline(c, *self.size), cm), area.shape, c.style.get("clip-rule") == "evenodd")
            clip = area * (1.0 if clip is None else clip)
        ref = self.ref(st.get("mask"))
        if ref is not None and ref.tag == "mask" and depth < DEPTH:
            clip = self.mask(ref, m, depth) * (1.0 if clip is None else clip)
        if n.tag in ("svg", "g", "a", "switch"):
            if n.tag == "svg" and n.parent is not None:
                m = multiply(m, self.viewport(n, n.attrs))
            for c in n.children:
                self.draw(c, m, opacity, clip, None, depth + 1)
        elif n.tag == "use":
            target = self.ref(n.attrs.get("href"))
            if target is not None:
                at = multiply(m, (1, 0, 0, 1, length(n.attrs.get("x"), self.size[0]), length(n.attrs.get("y"), self.size[1])))
                self.used(n, target, at, opacity, clip, depth)
        elif n.tag == "image":
            self.picture(n, m, opacity, clip)
        elif n.tag == "text":
            self.words(n, m, opacity, clip)
        elif st.get("visibility") not in ("hidden", "collapse"):
            self.shape(n, st, m, opacity, clip)

    def used(self, use: Node, target: Node, m: tuple, opacity: float, clip, depth: int) -> None:
        if target.tag in ("symbol", "svg"):
            box = {"width": use.attrs.get("width", target.attrs.get("width")), "height": use.attrs.get("height", target.attrs.get("height"))}
            m = multiply(m, self.viewport(target, {k: v for k, v in box.items() if v} | {"viewBox": target.attrs.get("viewBox", ""), "preserveAspectRatio": target.attrs.get("preserveAspectRatio", "")}))
            for c in target.children:
                self.draw(c, m, opacity, clip, {k: v for k, v in use.style.items() if k in INHERITED} | c.style, depth + 1)
        else:
            # What the target doesn't say itself comes from the use element.
            said = {k: v for k, v in target.style.items() if k not in INHERITED or target.parent is None or target.parent.style.get(k) != v}
            self.draw(target, m, opacity, clip, {k: v for k, v in use.style.items() if k in INHERITED} | said, depth + 1)

    def viewport(self, n: Node, box: dict) -> tuple:
        v = numbers(box.get("viewBox"))
        at = (1, 0, 0, 1, length(n.attrs.get("x")), length(n.attrs.get("y"))) if n.tag == "svg" else IDENTITY
        if len(v) != 4 or v[2] <= 0 or v[3] <= 0:
            return at
        return multiply(at, fitted(v, length(box.get("width"), self.size[0], default=v[2]), length(box.get("height"), self.size[1], default=v[3]), box.get("preserveAspectRatio")))

    def placed(self, lines: list, m: tuple) -> list[tuple[np.ndarray, bool]]:
        a, b, c, d, e, f = m
        out = []
        for pts, closed in lines:
            p = np.asarray(pts, float)
            out.append((np.column_stack([a * p[:, 0] + c * p[:, 1] + e, b * p[:, 0] + d * p[:, 1] + f]), closed))
        return out

    def shape(self, n: Node, st: dict, m: tuple, opacity: float, clip) -> None:
        lines = outline(n, *self.size)
        if not lines:
            return
        every = np.concatenate([np.asarray(p, float) for p, _ in lines])
        box = (*every.min(0), *every.max(0))
        shape = self.canvas.px.shape[:2]
        fill = st.get("fill", "black")
        if fill != "none" and n.tag != "line":
            self.paint(coverage(self.placed(lines, m), shape, st.get("fill-rule") == "evenodd"), fill, st, opacity * fraction(st.get("fill-opacity")), m, box, clip)
        stroke, width = st.get("stroke", "none"), length(st.get("stroke-width"), sum(self.size) / 2, default=1.0)
        if stroke != "none" and width > 0:
            dashes, shift = numbers(st.get("stroke-dasharray")), length(st.get("stroke-dashoffset"))
            cut = [part for p, c in lines for part in dashed(list(p), c, dashes, shift)]
            polys = stroke_outlines(cut, width, st.get("stroke-linecap", "butt"), st.get("stroke-linejoin", "miter"), length(st.get("stroke-miterlimit"), default=4.0))
            mask = np.zeros(shape, bool)
            for p in polys:
                mask |= coverage(self.placed([(p, True)], m), shape, False)
            self.paint(mask, stroke, st, opacity * fraction(st.get("stroke-opacity")), m, box, clip)

    def paint(self, mask: np.ndarray, value: str, st: dict, opacity: float, m: tuple, box: tuple, clip) -> None:
        if not mask.any():
            return
        g = self.ref(value) if "url(" in value else None
        if g is not None and g.tag == "pattern":
            full = self.pattern(g, m, box, mask)
            if full is not None:
                full[..., 3] = np.floor(full[..., 3] * opacity + 0.5)
                self.canvas.blend(mask, full, clip)
            return
        if g is not None and g.tag in ("lineargradient", "radialgradient"):
            rgba = self.gradient(g, m, box, mask)
            if rgba is None:
                return
            rgba[..., 3] = np.floor(rgba[..., 3] * opacity + 0.5)
            full = np.zeros((*mask.shape, 4), np.int64)
            full[mask] = rgba
            self.canvas.blend(mask, full, clip)
            return
        c = color(st.get("color", "black") if value == "currentColor" else value)
        if c is not None:
            self.canvas.blend(mask, (*c[:3], int(c[3] / 255 * opacity * 255 + 0.5)), clip)

    def mask(self, n: Node, m: tuple, depth: int) -> np.ndarray:
        """Luminance times alpha of a mask's content, 0..1."""
        kept = self.canvas
        self.canvas = Canvas(kept.px.shape[1], kept.px.shape[0], 1, 0)
        for c in n.children:
            self.draw(c, m, 1.0, None, None, depth + 1)
        px, self.canvas = self.canvas.px, kept
        if n.style.get("mask-type", n.attrs.get("mask-type")) == "alpha":
            return px[..., 3] / 255
        # Premultiplied channels already carry alpha.
        return (54 * px[..., 0] + 183 * px[..., 1] + 19 * px[..., 2] + 128 >> 8) / 255

    def pattern(self, g: Node, m: tuple, box: tuple, mask: np.ndarray) -> np.ndarray | None:
        """A tile drawn once at the canvas's scale, its content starting at its corner, repeated by the remainder of places."""
        chain = self.inheriting(g)

        def get(k: str, default: str) -> str:
            return next((n.attrs[k] for n in chain if k in n.attrs), default)

        children = next((n.children for n in chain if n.children), [])
        unit = get("patternUnits", "objectBoundingBox") == "objectBoundingBox"
        w, h = (box[2] - box[0], box[3] - box[1]) if unit else (1.0, 1.0)
        base = (1.0, 1.0) if unit else self.size
        x, y, tw, th = (length(get(k, "0"), b) * f for k, b, f in zip(("x", "y", "width", "height"), base * 2, (w, h, w, h)))
        if unit:
            x, y = x + box[0], y + box[1]
        a, b, c, d, e, f = multiply(m, transform(get("patternTransform", "")))
        det = a * d - b * c
        if tw <= 0 or th <= 0 or abs(det) < 1e-12:
            return None
        sx, sy = math.hypot(a, b), math.hypot(c, d)
        pw, ph = max(1, math.ceil(tw * sx - 1e-9)), max(1, math.ceil(th * sy - 1e-9))
        if pw * ph > 1 << 24:
            return None
        view = numbers(get("viewBox", ""))
        inner = fitted(view, pw, ph, get("preserveAspectRatio", "")) if len(view) == 4 and view[2] > 0 and view[3] > 0 else (pw / tw, 0, 0, ph / th, 0, 0)
        kept = self.canvas
        self.canvas = Canvas(pw, ph, 1, 0)
        for child in children:
            self.draw(child, inner, 1.0, None, None, 1)
        tile, self.canvas = self.canvas.px, kept
        alpha = tile[..., 3:]
        tile = np.concatenate([np.where(alpha > 0, tile[..., :3] * 255 // np.maximum(alpha, 1), 0), alpha], 2)
        ys, xs = np.nonzero(mask)
        px, py = xs + 0.5 - e, ys + 0.5 - f
        u, v = (d * px - c * py) / det - x, (a * py - b * px) / det - y
        full = np.zeros((*mask.shape, 4), np.int64)
        full[mask] = tile[np.minimum(ph - 1, (np.mod(v, th) / th * ph).astype(int)), np.minimum(pw - 1, (np.mod(u, tw) / tw * pw).astype(int))]
        return full

    def inheriting(self, g: Node) -> list[Node]:
        out = [g]
        while len(out) < DEPTH and (up := self.ref(out[-1].attrs.get("href"))) is not None and up not in out:
            out.append(up)
        return out

    def gradient(self, g: Node, m: tuple, box: tuple, mask: np.ndarray) -> np.ndarray | None:
        chain = self.inheriting(g)

        def get(k: str, default: str) -> str:
            return next((n.attrs[k] for n in chain if k in n.attrs), default)

        stops = next((s for n in chain if (s := [c for c in n.children if c.tag == "stop"])), [])
        if not stops:
            return None
        offsets = np.array([fraction(s.attrs.get("offset"), 0.0) for s in stops])
        colors = np.array([(*(c := color(s.style.get("stop-color", "black")) or (0, 0, 0, 255))[:3], c[3] * fraction(s.style.get("stop-opacity"))) for s in stops], float)
        order = np.argsort(offsets, kind="stable")
        offsets, colors = offsets[order], colors[order]
        unit = get("gradientUnits", "objectBoundingBox") == "objectBoundingBox"
        w, h = (1.0, 1.0) if unit else self.size
        space = multiply(m, (box[2] - box[0], 0, 0, box[3] - box[1], box[0], box[1])) if unit else m
        a, b, c, d, e, f = multiply(space, transform(get("gradientTransform", "")))
        det = a * d - b * c
        if abs(det) < 1e-12:
            return None
        ys, xs = np.nonzero(mask)
        px, py = xs + 0.5 - e, ys + 0.5 - f
        x, y = (d * px - c * py) / det, (a * py - b * px) / det
        if g.tag == "lineargradient":
            x1, y1, x2, y2 = (length(get(k, v), s) for k, v, s in (("x1", "0%", w), ("y1", "0%", h), ("x2", "100%", w), ("y2", "0%", h)))
            size = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size if size else np.ones(len(x))
        else:
            cx, cy, r = (length(get(k, "50%"), s) for k, s in (("cx", w), ("cy", h), ("r", (w + h) / 2)))
            fx, fy = length(get("fx", ""), w, default=cx), length(get("fy", ""), h, default=cy)
            dx, dy, ex, ey = x - fx, y - fy, fx - cx, fy - cy
            # The ray from the focus through a point meets the circle at distance 1/t.
            A, B, C = dx * dx + dy * dy, dx * ex + dy * ey, ex * ex + ey * ey - r * r
            t = A / np.maximum(1e-12, -B + np.sqrt(np.maximum(0, B * B - A * C))) if r > 0 else np.ones(len(x))
        method = get("spreadMethod", "pad")
        if method == "repeat":
            t = t - np.floor(t)
        elif method == "reflect":
            t = 1 - np.abs(np.mod(t, 2) - 1)
        t = np.clip(t, 0, 1)
        return np.column_stack([np.floor(np.interp(t, offsets, colors[:, k]) + 0.5) for k in range(4)])

    def picture(self, n: Node, m: tuple, opacity: float, clip) -> None:
        """A data URI, by nearest samples."""
        px = href_image(n.attrs.get("href", ""))
        if px is None:
            return
        w, h = length(n.attrs.get("width"), self.size[0], default=px.shape[1]), length(n.attrs.get("height"), self.size[1], default=px.shape[0])
        at = multiply(m, (1, 0, 0, 1, length(n.attrs.get("x")), length(n.attrs.get("y"))))
        a, b, c, d, e, f = multiply(at, fitted([0, 0, px.shape[1], px.shape[0]], w, h, n.attrs.get("preserveAspectRatio")))
        det = a * d - b * c
        if abs(det) < 1e-12:
            return
        y, x = np.mgrid[: self.canvas.px.shape[0], : self.canvas.px.shape[1]] + 0.5
        u, v = np.floor((d * (x - e) - c * (y - f)) / det).astype(int), np.floor((a * (y - f) - b * (x - e)) / det).astype(int)
        mask = (u >= 0) & (v >= 0) & (u < px.shape[1]) & (v < px.shape[0])
        full = px[np.clip(v, 0, px.shape[0] - 1), np.clip(u, 0, px.shape[1] - 1)].astype(np.int64)
        full[..., 3] = np.floor(full[..., 3] * opacity + 0.5)
        self.canvas.blend(mask, full, clip)

    def words(self, n: Node, m: tuple, opacity: float, clip) -> None:
        size = length(n.style.get("font-size"), default=16.0)
        said = " ".join(n.text.split())
        wide = 0.6 * size * len(said)
        x = length(n.attrs.get("x"), self.size[0]) - {"middle": wide / 2, "end": wide}.get(n.style.get("text-anchor"), 0.0)
        y = length(n.attrs.get("y"), self.size[1]) - size
        c = color(n.style.get("fill", "black"))
        if c is None:
            return
        cells = [([(px, py), (px + 0.6 * size / 8, py), (px + 0.6 * size / 8, py + size / 8), (px, py + size / 8)], True)
                 for k, ch in enumerate(said) if ch != " " for j, row in enumerate(self.glyph(ch)) for i in range(8) if row >> i & 1
                 for px, py in [(x + k * 0.6 * size + i * 0.6 * size / 8, y + j * size / 8)]]
        if cells:
            mask = coverage(self.placed(cells, m), self.canvas.px.shape[:2], False)
            self.canvas.blend(mask, (*c[:3], int(c[3] / 255 * opacity * fraction(n.style.get("fill-opacity")) * 255 + 0.5)), clip)


def href_image(href: str) -> np.ndarray | None:
    m = re.match(r"data:[^,]*?(;base64)?,(.*)", href.strip(), re.S)
    if not m:
        return None  # files and addresses are never read
    raw = base64.b64decode(re.sub(r"\s", "", m[2])) if m[1] else unquote_to_bytes(m[2])
    try:
        from pixelloom.sources.codecs import bmp, gif, jpeg, png

        for magic, codec in ((b"\x89PNG", png), (b"\xff\xd8", jpeg), (b"GIF8", gif), (b"BM", bmp)):
            if raw.startswith(magic):
                return codec.decode(raw).rgba
    except ImageError:
        pass
    return None


def fitted(v: list[float], w: float, h: float, aspect: str | None) -> tuple:
    """A view box onto a rectangle of w by h."""
    sx, sy = w / v[2], h / v[3]
    words = (aspect or "xMidYMid").split()
    if words[:1] == ["none"]:
        return (sx, 0, 0, sy, -v[0] * sx, -v[1] * sy)
    s = max(sx, sy) if "slice" in words else min(sx, sy)
    share = {"Min": 0.0, "Mid": 0.5, "Max": 1.0}
    m = re.match(r"x(Min|Mid|Max)Y(Min|Mid|Max)", words[0] if words else "")
    ax, ay = (share[m[1]], share[m[2]]) if m else (0.5, 0.5)
    return (s, 0, 0, s, (w - v[2] * s) * ax - v[0] * s, (h - v[3] * s) * ay - v[1] * s)


def dimensions(root: Node, dpi: float = 96.0) -> tuple[float, float]:
    """Width and height by attributes, else the view box, else 512."""
    v = numbers(root.attrs.get("viewBox"))
    box = v[2:] if len(v) == 4 else [512.0, 512.0]

    def one(k: str, d: float) -> float:
        s = root.attrs.get(k, "")
        return d if s.strip().endswith("%") else length(s, 0.0, dpi, d)

    w, h = one("width", box[0]), one("height", box[1])
    need(w > 0 and h > 0, "invalid SVG dimensions")
    return w, h


def decode(data: bytes, *, width: int = 0, height: int = 0, scale: float = 1.0, dpi: float = 96.0, time: float = 0.0, supersampling: int = 2, background: int = 0, glyph=block) -> Image:
    root = parse(data)
    for n in root.walk():
        animated(n, max(0.0, time))
    resolve(root, {}, rules_of(root))
    frames = keyframes_of(root)
    for n in root.walk() if frames else ():
        css_animated(n, frames, max(0.0, time))
    w, h = dimensions(root, dpi)
    ow, oh = (width, height) if width and height else (width, h * width / w) if width else (w * height / h, height) if height else (w, h)
    ow, oh = max(1, int(ow * scale + 0.5)), max(1, int(oh * scale + 0.5))
    ss = supersampling if supersampling in (1, 2, 4) else 2
    need(ow * oh * ss * ss <= 1 << 28, "image too large")
    v = numbers(root.attrs.get("viewBox"))
    v = v if len(v) == 4 and v[2] > 0 and v[3] > 0 else [0.0, 0.0, w, h]
    canvas = Canvas(ow, oh, ss, background)
    view = multiply((ss, 0, 0, ss, 0, 0), fitted(v, ow, oh, root.attrs.get("preserveAspectRatio")))
    Renderer(root, canvas, (v[2], v[3]), glyph).draw(root, view, 1.0, None)
    return image(canvas.resolved())
