"""Blocks, sentences and tokens of a normalised view, and small predicates on them."""

from __future__ import annotations

from functools import lru_cache

import regex

from glyphloom.functions.chars import alnum, lower_ascii

_TOKEN = regex.compile(r"\S+")
_EDGE = regex.compile(r"^[^\p{Alphabetic}\p{N}']+|[^\p{Alphabetic}\p{N}']+$")
_GAP = regex.compile(r"[ \t]{1,9}")
_STOP = regex.compile(r"[.!?]")
Span = tuple[int, int]


def block_spans(text: str, starts: list[int]) -> list[Span]:
    out = []
    cuts = [*starts, len(text)]
    for a, b in zip(cuts, cuts[1:]):
        b = a + len(text[a:b].rstrip())
        if a < b:
            out.append((a, b))
    return out


def period_ends(text: str, at: int) -> bool:
    """Whether a period ending at ``at`` closes a sentence."""
    nxt = text[at : at + 1]
    if not nxt:
        return True
    if alnum(nxt):
        return False
    if nxt not in " \t":
        return True
    m = _GAP.match(text, at)
    if m.end() - at > 8:
        return True
    c = text[m.end() : m.end() + 1]
    return not c or c in "\r\n" or not c.islower()


def sentence_spans(text: str, block: Span) -> list[Span]:
    out = []
    start, stop = block
    for m in _STOP.finditer(text, *block):
        if m[0] == "." and not period_ends(text, m.end()):
            continue
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end()
    if text[start:stop].strip():
        out.append((start, stop))
    return out


def tokens(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _TOKEN.finditer(text)]


@lru_cache(maxsize=1 << 16)
def bare(token: str) -> str:
    return lower_ascii(_EDGE.sub("", token))


def find_word(low: str, needle: str, start: int = 0) -> int:
    """First place of ``needle`` with no letter or digit beside it, or -1."""
    at = low.find(needle, start)
    while at >= 0:
        if not alnum(low[at - 1 : at] if at else "") and not alnum(low[at + len(needle) : at + len(needle) + 1]):
            return at
        at = low.find(needle, at + 1)
    return -1
