"""Text fragments with their places from simple PDF files (objects in plain sight, Flate streams, one text matrix)."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.operators.layout import each_page

SCHEMA = "path string, page long, place long, x double, y double, text string"
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def unescape(raw: bytes) -> str:
    """A string in parentheses: backslash escapes and octal codes, in the Windows code page for Western scripts."""
    out = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return out.decode("cp1252", "replace")


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    return unescape(token[1:-1])


def fragments(stream: bytes) -> list[tuple[float, float, str]]:
    """x, y and text of each string that the stream shows, in its order."""
    out: list[tuple[float, float, str]] = []
    stack: list = []
    x = y = start = leading = 0.0
    for token in _TOKEN.findall(stream):
        head = token[:1]
        if head in b"(<":
            stack.append(_text(token))
        elif head.isdigit() or head in b"+-.":
            stack.append(float(token))
        elif token in (b"[", b"]"):
            continue
        else:
            numbers = [v for v in stack if isinstance(v, float)]
            if token == b"BT":
                x = y = start = 0.0
            elif token == b"Tm" and len(numbers) >= 6:
                start = x = numbers[-2]
                y = numbers[-1]
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                start = x = start + numbers[-2]
                y += numbers[-1]
                leading = -numbers[-1] if token == b"TD" else leading
            elif token == b"TL" and numbers:
                leading = numbers[-1]
            elif token in (b"T*", b"'", b'"'):
                x, y = start, y - leading
            if token in (b"Tj", b"TJ", b"'", b'"'):
                shown = "".join(v for v in stack if isinstance(v, str))
                if shown.strip():
                    out.append((x, y, shown))
            stack = []
    return out


def _inflate(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def pages(content: bytes) -> list[bytes]:
    """The content of each page in the order of the page tree."""
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    refs = lambda text: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", text)]
    found: list[bytes] = []
    seen: set[int] = set()

    def visit(number: int) -> None:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for kid in refs(kids[1]):
                visit(kid)
        elif re.search(rb"/Type\s*/Page\b", body):
            contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
            found.append(b"\n".join(_inflate(objects.get(n, b"")) for n in refs(contents[1])) if contents else b"")

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    for root in roots or [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]:
        visit(root)
    return found


def read(content: bytes) -> list[tuple[int, int, float, float, str]]:
    return [(p, k, x, y, text) for p, stream in enumerate(pages(content)) for k, (x, y, text) in enumerate(fragments(stream))]


def pdf_fragments(spark: SparkSession, path: str) -> DataFrame:
    """path, page, place, x, y and text of every fragment of the files."""
    return each_page(spark.read.format("binaryFile").load(path), read, SCHEMA)
