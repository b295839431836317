"""Text of simple PDF files without a library: streams that are plain or deflated, text operators, WinAnsi or ToUnicode text.

Encrypted files, other filters and pages that are images raise ValueError, so that a folder of files shows them as errors. Blocks are lines
that lie close together; a block is a table where its lines are dense, spread over columns or hold pipes, and a heading by its words."""

from __future__ import annotations

import re
import statistics
import zlib
from typing import NamedTuple

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
LINE_GAP, DENSE, SPREAD, WORDS_APART = 1.6, 12.0, 80.0, 6


class Line(NamedTuple):
    x: float
    y: float
    size: float
    parts: list[tuple[float, str]]

    @property
    def text(self) -> str:
        return " ".join(t for _, t in self.parts)


def _data(body: bytes) -> bytes | None:
    found = _STREAM.search(body)
    if not found:
        return None
    head = body[: found.start()]
    if b"/Filter" not in head:
        return found[1]
    names = re.findall(rb"/(\w+Decode)", head)
    if names != [b"FlateDecode"]:
        raise ValueError(f"filter {b' '.join(names).decode()}")
    return zlib.decompressobj().decompress(found[1])


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            raw = _data(body) or b""
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, raw[:first].split()))
            pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
            for (number, at), after in zip(pairs, [*(p[1] for p in pairs[1:]), len(raw) - first], strict=True):
                out.setdefault(number, raw[first + at : first + after])
    return out


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in reading order: by the tree of pages, else by number."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)

    def below(body: bytes) -> list[bytes]:
        if not re.search(rb"/Type\s*/Pages\b", body):
            return [body]
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        return [p for n in re.findall(rb"(\d+)\s+\d+\s+R", kids[1] if kids else b"") if int(n) in objects for p in below(objects[int(n)])]

    return below(root) if root else [objects[n] for n in sorted(objects) if re.search(rb"/Type\s*/Page\b", objects[n])]


def _unicode_map(objects: dict[int, bytes], page: bytes) -> dict[str, dict[int, str]]:
    """For each font of a page its map from two-byte codes to text, where it has one."""
    out: dict[str, dict[int, str]] = {}
    fonts = re.search(rb"/Font\s*<<(.*?)>>", page, re.S)
    for name, number in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", fonts[1] if fonts else b""):
        found = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), b""))
        if not found:
            continue
        told, codes = _data(objects[int(found[1])]) or b"", {}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", told, re.S):
            for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block):
                codes[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", told, re.S):
            for a, b, c in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", block):
                codes |= {i: chr(int(c, 16) + i - int(a, 16)) for i in range(int(a, 16), int(b, 16) + 1)}
        out[name.decode()] = codes
    return out


def _string(token: bytes, codes: dict[int, str] | None) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if codes:
        return "".join(codes.get(raw[i] << 8 | raw[i + 1], "") for i in range(0, len(raw) - 1, 2))
    return raw.decode("cp1252", "replace")


def _shown(content: bytes, fonts: dict[str, dict[int, str]]) -> list[tuple[float, float, float, str]]:
    """x, y, font size and text of every string that a content stream shows."""
    out, stack = [], []
    x = y = start = size = lead = 0.0
    codes = None
    listed: list | None = None
    for token in _TOKEN.findall(content):
        if token == b"[":
            listed = []
        elif token == b"]":
            stack.append(listed or [])
            listed = None
        elif token[:1] in b"(<":
            (stack if listed is None else listed).append(_string(token, codes))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            (stack if listed is None else listed).append(float(token))
        elif token.startswith(b"/"):
            stack.append(token[1:].decode("latin-1"))
        else:
            said = None
            match token.decode("latin-1"), stack:
                case "BT", _:
                    x = y = start = 0.0
                case "Tf", [*_, str(name), float(points)]:
                    codes, size = fonts.get(name), points
                case "TL", [*_, float(lead)]:
                    pass
                case "Td", [*_, float(dx), float(dy)]:
                    x, y = start + dx, y + dy
                    start = x
                case "TD", [*_, float(dx), float(dy)]:
                    x, y, lead = start + dx, y + dy, -dy
                    start = x
                case "Tm", [*_, float(a), float(), float(), float(d), float(e), float(f)]:
                    x, y, start, size = e, f, e, size * (abs(d or a) if size and abs(d or a) != 1 else 1)
                case "T*", _:
                    x, y = start, y - lead
                case "Tj", [*_, str(text)]:
                    said = text
                case "'" | '"', [*_, str(text)]:
                    x, y, said = start, y - lead, text
                case "TJ", [*_, list(parts)]:
                    said = "".join(p if isinstance(p, str) else " " if p < -200 else "" for p in parts)
            if said:
                out.append((x, y, size or 10.0, said))
                x += len(said) * (size or 10.0) * 0.5
            stack = []
    return out


def _lines(shown: list[tuple[float, float, float, str]]) -> list[Line]:
    out: list[Line] = []
    for x, y, size, text in shown:
        if out and abs(out[-1].y - y) < 1:
            out[-1].parts.append((x, text))
        else:
            out.append(Line(x, y, size, [(x, text)]))
    return [line for line in out if line.text.strip()]


def is_table(lines: list[Line]) -> bool:
    """Three lines or more less than DENSE apart, strings spread over columns, or pipes between cells."""
    if len(lines) < 2:
        return False
    height = abs(lines[0].y - lines[-1].y) + lines[-1].size
    if len(lines) >= 3 and height / len(lines) < DENSE:
        return True
    starts = [x for line in lines for x, _ in line.parts]
    if len(starts) >= WORDS_APART and statistics.stdev(starts) > SPREAD:
        return True
    return any(" | " in line.text for line in lines)


def blocks(data: bytes) -> list[tuple[int, bool, str]]:
    """(page, table, text) of the blocks of a PDF file."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF file")
    objects, out = _objects(data), []
    for number, page in enumerate(_pages(objects), 1):
        inner = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
        fonts = _unicode_map(objects, page + (objects.get(int(inner[1]), b"") if inner else b""))
        named = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", page, re.S)
        parts = re.findall(rb"(\d+)\s+\d+\s+R", named[1]) if named and named[1] else [named[2]] if named else []
        lines = _lines(_shown(b"\n".join(_data(objects[int(p)]) or b"" for p in parts if int(p) in objects), fonts))
        held: list[Line] = []
        for line in [*lines, None]:
            if held and (line is None or abs(held[-1].y - line.y) > LINE_GAP * max(held[-1].size, line.size) or line.size != held[-1].size):
                table = is_table(held)
                out.append((number, table, "\n".join(" | ".join(t.strip() for _, t in h.parts) for h in held) if table else " ".join(h.text.strip() for h in held)))
                held = []
            if line:
                held.append(line)
    if not out:
        raise ValueError("no text in the PDF file")
    return out


def read(data: bytes) -> str:
    """A PDF file's blocks as Markdown, an empty line between two: table rows between pipes, all else as it is."""
    as_rows = lambda text: "\n".join(f"| {row} |" for row in text.split("\n"))
    return "\n\n".join(as_rows(text) if table else text for _, table, text in blocks(data))
