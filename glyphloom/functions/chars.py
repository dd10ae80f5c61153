"""Character classes, offsets and tables of the text engine."""

from __future__ import annotations

import numpy as np
import regex

WORD = regex.compile(r"\p{XID_Continue}+")
TOKEN = regex.compile(r"\S+")
ALNUM_RUN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_CONT = regex.compile(r"\p{XID_Continue}")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# Glyphs that open a pasted bullet.
BULLETS = "•‣⁃∙"
# Code points that may decorate the opening of a line.
DECORATION = (
    (0x200D, 0x200D), (0x20E3, 0x20E3), (0xFE0E, 0xFE0F), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122),
    (0x2139, 0x2139), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x24C2, 0x24C2), (0x25A0, 0x25FF), (0x2600, 0x27BF),
    (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF),
)
# Code points without a visible shape (default ignorable).
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Letters of other scripts drawn like a Latin letter, and that letter.
LOOKALIKES = dict(zip(
    "авекмнорстухіјѕ" "АВЕКМНОРСТУХІЈЅ" "αικνορυχ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abekmhopctyxijs" "ABEKMHOPCTYXIJS" "aikvopux" "ABEZHIKMNOPTYX",
    strict=True,
))
# The character entities the rules can reach.
ENTITIES = {
    "&mdash;": "—", "&#8212;": "—", "&#x2014;": "—", "&ndash;": "–", "&#8211;": "–", "&#x2013;": "–", "&hellip;": "…",
    "&nbsp;": " ", "&#160;": " ", "&emsp;": " ", "&ensp;": " ", "&thinsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">",
    "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&semi;": ";", "&#59;": ";", "&ldquo;": "“", "&rdquo;": "”",
    "&lsquo;": "‘", "&rsquo;": "’", "&#8220;": "“", "&#8221;": "”", "&#8216;": "‘", "&#8217;": "’",
}


def _klass(ranges: tuple) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


DECOR_TAIL = regex.compile(rf"[\s{BULLETS}{_klass(DECORATION)}]*\Z")
IS_DECOR = regex.compile(rf"[\s{BULLETS}{_klass(DECORATION)}]*")
INVISIBLE = regex.compile(f"[{_klass(IGNORABLE)}]")
NUMERIC_REF = regex.compile(r"&#(?:([xX])([0-9a-fA-F]+)|([0-9]+));")
LOOSE_REF = regex.compile(r"&#(?:[xX][0-9a-fA-F]+|[0-9]+);?")
SPACES = regex.compile(r"\p{Zs}")
HIDDEN = regex.compile(rf"[\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}{_klass(IGNORABLE)}]")


def cont(c: str) -> bool:
    """Whether a character continues a word."""
    return bool(c) and _CONT.match(c) is not None


def alnum(c: str) -> bool:
    return bool(c) and _ALNUM.match(c) is not None


def lower_ascii(s: str) -> str:
    # bytes.lower() touches ASCII letters only
    return s.lower() if s.isascii() else s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(s: str) -> int:
    return len(WORD.findall(s))


def byte_table(s: str) -> np.ndarray | None:
    """UTF-8 byte offset of every code point and of the end; None for ASCII text, where offsets agree."""
    if s.isascii():
        return None
    o = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    size = 1 + (o >= 0x80).astype(np.int64) + (o >= 0x800) + (o >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)])


def numeric_ref(s: str, at: int) -> tuple[str, int, str]:
    """(verdict, length, character) of a numeric reference: decode, suppress, overlong or literal."""
    m = NUMERIC_REF.match(s, at)
    if not m:
        return "literal", 0, ""
    digits = m[2] or m[3]
    if len(digits) > (6 if m[1] else 7):
        return "overlong", m.end() - at, ""
    value = int(digits, 16 if m[1] else 10)
    c = chr(value) if value <= 0x10FFFF and not 0xD800 <= value <= 0xDFFF else "\ufffd"
    if SPACES.match(c):
        return "decode", m.end() - at, " "
    if c.isspace() or HIDDEN.match(c):
        return "suppress", m.end() - at, ""
    return "decode", m.end() - at, c


def entity(s: str, at: int) -> tuple[int, str] | None:
    end = s.find(";", at, at + 9)
    if end < 0:
        return None
    hit = ENTITIES.get(s[at : end + 1])
    return (end + 1 - at, hit) if hit is not None else None
