"""Input preparation and the guard against program source."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

MAX_BYTES = 2 * 1024 * 1024
MIN_LINES, MIN_PERCENT = 8, 35
# Words that open a line of program source.
KEYWORDS = frozenset("fn struct enum impl trait mod use const static type let match extern".split())
MODIFIERS = frozenset(["pub", "pub(crate)", "async", "unsafe"])


@dataclass
class Prepared:
    text: str
    sha256: str
    size: int
    bom: bool
    mixed: bool
    error: str | None = None


def prepare(raw: bytes, max_bytes: int = MAX_BYTES) -> Prepared:
    digest = hashlib.sha256(raw).hexdigest()
    if len(raw) > max_bytes:
        return Prepared("", digest, len(raw), False, False, f"input is {len(raw)} bytes, over the {max_bytes} byte limit")
    bom = raw.startswith(b"\xef\xbb\xbf")
    body = raw[3:] if bom else raw
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError as e:
        return Prepared("", digest, len(raw), bom, False, f"input is not UTF-8 at byte {e.start}")
    return Prepared(text, digest, len(raw), bom, "\r\n" in text and re.search(r"(?<!\r)\n", text) is not None)


def code_line(t: str) -> bool:
    if t.startswith(("#[", "#![", "//")) or re.fullmatch(r"[{}()\[\];,]+", t):
        return True
    if t[-1] not in "{};(),]":
        return False
    words = t.split()
    head = words[1] if words[0] in MODIFIERS and len(words) > 1 else words[0]
    m = re.match(r"\w*", head)
    return (m[0] if m else "") in KEYWORDS or "::" in t or "->" in t or "=>" in t or field_line(t)


def field_line(t: str) -> bool:
    m = re.fullmatch(r"(?:pub(?:\(crate\))? )?\s*([^\W\d]\w*)\s*:(?!:)\s*(\S.*?)\s*,", t)
    if not m:
        return False
    kind = m[2]
    compact = "".join(kind.split())
    if len(kind.split()) > 1 and not re.search("[<&:]", compact):
        return False
    return re.fullmatch(r"[\w&(\[][\w:<>&',\[\]()]*", compact) is not None


def source_lines(text: str, code: list[tuple[int, int]]) -> tuple[int, int]:
    """(source-shaped lines, non-blank lines) outside the code blocks."""
    shaped = lines = at = 0
    code = sorted(code)
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
        t = m[0].strip()
        while at < len(code) and code[at][1] <= m.start():
            at += 1
        if t and not (at < len(code) and code[at][0] < m.end()):
            lines += 1
            shaped += code_line(t)
    return shaped, lines


def looks_like_source(text: str, code: list[tuple[int, int]]) -> str | None:
    shaped, lines = source_lines(text, code)
    if shaped >= MIN_LINES and shaped * 100 >= MIN_PERCENT * lines:
        return f"{shaped} of {lines} lines outside code blocks look like program source"
    return None
