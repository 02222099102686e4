"""A small reader of PDF files: pages of text by the fonts' character maps, lines and columns by position, and the file's own metadata. No encryption."""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"/[^\s/<>\[\]()]+|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
ENTRIES = {"author": b"Author", "title": b"Title", "moddate": b"ModDate"}


def _bytes(token: bytes) -> bytes:
    """What a literal or hexadecimal string holds."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else named.get(m[1], m[1])
    return ESCAPED.sub(one, token[1:-1])


def _string(token: bytes) -> str:
    """A string outside of pages as text."""
    raw = _bytes(token)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _stream(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"FlateDecode" in body[:found.start()] else found[1]


def _objects(content: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in OBJECT.finditer(content)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            inner, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in inner[:first].split()]
            starts = heads[1::2]
            for number, a, b in zip(heads[::2], starts, [*starts[1:], len(inner)]):
                out.setdefault(number, inner[first + a:first + b if b < len(inner) else len(inner)])
    return out


def _refs(body: bytes, key: bytes) -> list[int]:
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


@dataclass
class Font:
    """How codes are read: `width` bytes each, by `chars` where they are in it; others by cp1252, or not at all where they have two bytes."""

    width: int = 1
    chars: dict[int, str] = field(default_factory=dict)

    def text(self, raw: bytes) -> str:
        if raw.startswith(b"\xfe\xff") and not self.chars:
            return raw[2:].decode("utf-16-be", "replace")
        codes = [int.from_bytes(raw[i:i + self.width], "big") for i in range(0, len(raw), self.width)]
        other = (lambda c: bytes([c]).decode("cp1252", "replace")) if self.width == 1 else (lambda c: "")
        return "".join(self.chars[c] if c in self.chars else other(c) for c in codes)


HEX = rb"<([0-9A-Fa-f\s]*)>"


def character_map(raw: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code: text) of a ToUnicode map: single codes, and ranges with one begin or a list."""
    number = lambda x: int(re.sub(rb"\s", b"", x) or b"0", 16)
    text = lambda x: bytes.fromhex(re.sub(rb"\s", b"", x).decode()).decode("utf-16-be", "replace")
    chars: dict[int, str] = {}
    width = 1
    for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", raw, re.S):
        width = max([width, *(len(re.sub(rb"\s", b"", x)) // 2 for x in re.findall(HEX, block))])
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for code, to in re.findall(HEX + rb"\s*" + HEX, block):
            chars[number(code)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for low, high, to, listed in re.findall(HEX + rb"\s*" + HEX + rb"\s*(?:" + HEX + rb"|\[([^\]]*)\])", block):
            codes = range(number(low), min(number(high), number(low) + 0xFFFF) + 1)
            if listed:
                chars |= {c: text(x) for c, x in zip(codes, re.findall(HEX, listed))}
            else:
                first = text(to)
                chars |= {c: first[:-1] + chr(min(0x10FFFF, ord(first[-1]) + i)) for i, c in enumerate(codes) if first}
    return width, chars


#: What glyph names stand for where they aren't names of single letters or of code points.
GLYPHS = {
    "space": " ", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "quoteright": "\u2019", "quoteleft": "\u2018", "quotedblleft": "\u201c", "quotedblright": "\u201d", "endash": "\u2013", "emdash": "\u2014",
    "bullet": "\u2022", "hyphen": "-", "minus": "\u2212", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "slash": "/",
    "question": "?", "exclam": "!", "quotesingle": "'", "quotedbl": '"', "ampersand": "&", "percent": "%", "equal": "=", "plus": "+", "asterisk": "*", "underscore": "_", "dotlessi": "\u0131", "germandbls": "\u00df",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "cedilla": "\u0327", "caron": "\u030c", "ring": "\u030a"}


def glyph(name: str) -> str:
    """The text of a glyph by its name, '' if that says nothing."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if found := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(found[1] or found[2], 16))
    accent = next((a for a in ACCENTS if name[1:] == a), None)
    return unicodedata.normalize("NFC", name[0] + ACCENTS[accent]) if accent else ""


def _part(body: bytes, key: bytes, objects: dict[int, bytes]) -> bytes:
    """The dictionary or object under a key, inline or by reference."""
    found = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|(?=<<|\[|/))", body)
    if not found:
        return b""
    if found[1]:
        return objects.get(int(found[1]), b"")
    rest = body[found.end():]
    if not rest.startswith(b"<<"):
        return rest[:rest.find(b"]") + 1] if rest.startswith(b"[") else (re.match(rb"/[^\s/<>\[\]()]*", rest) or [b""])[0]
    depth = 0
    for m in re.finditer(rb"<<|>>", rest):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return rest[:m.end()]
    return rest


def _font(body: bytes, objects: dict[int, bytes]) -> Font:
    """A font by its character map, else by the names that its encoding gives to codes."""
    two = bool(re.search(rb"/Subtype\s*/Type0\b", body))
    found = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)
    if found:
        width, chars = character_map(_stream(objects.get(int(found[1]), b"")))
        return Font(2 if two else width, chars)
    font = Font(2 if two else 1)
    named = re.search(rb"/Differences\s*\[([^\]]*)\]", _part(body, b"Encoding", objects))
    code = 0
    for x in re.findall(rb"\d+|/[^\s/\[\]]+", named[1]) if named else []:
        if x.startswith(b"/"):
            if t := glyph(x[1:].decode("latin-1")):
                font.chars[code] = t
            code += 1
        else:
            code = int(x)
    return font


def _fonts(resources: bytes, objects: dict[int, bytes]) -> dict[bytes, Font]:
    listed = _part(resources, b"Font", objects)
    return {b"/" + name: _font(objects.get(int(n), b""), objects) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed)}


@dataclass
class Run:
    """Text at a place: x and y of its begin, the x that it reaches by estimate, and its size."""

    x: float
    y: float
    end: float
    size: float
    text: str


def runs(stream: bytes, fonts: dict[bytes, Font]) -> list[Run]:
    """What a page's instructions show, and where. Widths aren't read: a sign is taken for half as wide as high."""
    out: list[Run] = []
    held: list[bytes] = []
    font, size, leading = Font(), 12.0, 0.0
    line, at, scale = (0.0, 0.0), (0.0, 0.0), 1.0
    number = lambda x: float(x) if re.fullmatch(rb"-?\d*\.?\d+", x) else 0.0

    def move(dx: float, dy: float) -> None:
        nonlocal line, at
        line = at = (line[0] + dx * scale, line[1] + dy * scale)

    def show(tokens: list[bytes], spread: bool) -> None:
        nonlocal at
        text, wide = "", 0.0
        for x in tokens:
            if x[:1] in b"(<":
                own = font.text(_bytes(x))
                text += own
                wide += 0.5 * len(own)
            elif spread:
                gap = number(x)
                wide -= gap / 1000
                if gap < -200 and text and not text.endswith(" "):  # as wide as a space
                    text += " "
        end = at[0] + wide * size * scale
        if text.strip():
            out.append(Run(at[0], at[1], end, size * scale, text))
        at = (end, at[1])

    for token in SHOWN.findall(stream):
        if token[:1] in b"(</" or re.fullmatch(rb"-?\d*\.?\d+", token):
            held.append(token)
            continue
        if token in (b"[", b"]"):
            continue
        values = [number(x) for x in held]
        if token == b"BT":
            line = at = (0.0, 0.0)
            scale = 1.0
        elif token == b"Tf" and len(held) >= 2:
            font, size = fonts.get(held[-2], Font()), abs(values[-1]) or 12.0
        elif token == b"TL" and held:
            leading = values[-1]
        elif token in (b"Td", b"TD") and len(held) >= 2:
            if token == b"TD":
                leading = -values[-1]
            move(*values[-2:])
        elif token == b"Tm" and len(held) >= 6:
            line = at = (values[-2], values[-1])
            scale = abs(values[-3]) or abs(values[-5]) or 1.0
        elif token in (b"T*", b"'", b'"'):
            move(0.0, -(leading or size))
        if token in (b"Tj", b"TJ", b"'", b'"'):
            show([x for x in held if x[:1] in b"(<" or token == b"TJ"], token == b"TJ")
        held = []
    return out


def _lines(found: list[Run]) -> list[list[Run]]:
    """Runs by line, from the top, each from the left; a line is what stands within half a sign's height."""
    out: list[list[Run]] = []
    for r in sorted(found, key=lambda r: -r.y):
        if out and abs(out[-1][0].y - r.y) <= 0.4 * max(r.size, out[-1][0].size):
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(x, key=lambda r: r.x) for x in out]


def _joined(line: list[Run]) -> str:
    text = ""
    for i, r in enumerate(line):
        gap = r.x - line[i - 1].end if i else 0.0
        text += (" " if i and gap > 0.15 * r.size and not text.endswith(" ") and not r.text.startswith(" ") else "") + r.text
    return text.strip()


def _gutter(lines: list[list[Run]]) -> float | None:
    """Where two columns part: an x that many lines leave free between text on both its sides and few go over."""
    begins = sorted({round(b.x) for line in lines for a, b in zip(line, line[1:]) if b.x - a.end > 1.5 * b.size})
    begins = begins or sorted({round(line[0].x) for line in lines})[1:]
    for x in begins:
        left = [line for line in lines if line[0].x < x - 1]
        right = [line for line in lines if any(abs(r.x - x) <= 2 for r in line)]
        over = [line for line in left if any(r.x < x - 1 and r.end > x for r in line)]
        if len(right) >= 3 and len(left) >= 3 and len(over) <= 0.4 * len(lines) and any(r.end < x for line in left for r in line[:1]):
            return x - 1
    return None


def page_text(found: list[Run]) -> str:
    """The lines of a page from the top; where it has two columns, the left one before the right one, between lines that go over both."""
    lines = _lines(found)
    x = _gutter(lines)
    if x is None:
        return "\n".join(filter(None, map(_joined, lines)))
    out: list[str] = []
    sides: tuple[list[str], list[str]] = ([], [])
    for line in [*lines, None]:
        if line is None or any(r.x < x < r.end for r in line):
            out += sides[0] + sides[1]
            sides = ([], [])
            out += [_joined(line)] if line else []
        else:
            for side, own in zip(sides, ([r for r in line if r.x < x], [r for r in line if r.x >= x])):
                side.append(_joined(own))
    return "\n".join(filter(None, out))


def read(content: bytes) -> tuple[list[str], dict[str, str]]:
    """(text of each page, metadata: author, title, moddate, language, total_pages) of a PDF file; ValueError if it is none."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content[-4096:]:
        raise ValueError("an encrypted PDF file")
    objects = _objects(content)
    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    pages, todo, seen = [], [(n, b"") for n in _refs(catalog, b"Pages")[::-1]], set()
    while todo:
        number, above = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        resources = _part(body, b"Resources", objects) or above  # a page has those of what holds it
        if re.search(rb"/Type\s*/Pages\b", body):
            todo += [(n, resources) for n in _refs(body, b"Kids")[::-1]]
        elif re.search(rb"/Type\s*/Page\b", body):
            stream = b"\n".join(_stream(objects.get(n, b"")) for n in _refs(body, b"Contents"))
            pages.append(page_text(runs(stream, _fonts(resources, objects))))
    about = {}
    info = objects.get(next(iter(_refs(content[content.rfind(b"trailer"):], b"Info")), -1), b"")
    for name, key in ENTRIES.items():
        found = re.search(rb"/" + key + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", info)
        if found:
            about[name] = _string(found[1])
    lang = re.search(rb"/Lang\s*(\((?:[^()\\]|\\.)*\))", catalog)
    return pages, about | ({"language": _string(lang[1])} if lang else {}) | {"total_pages": str(len(pages))}
