"""Visible text, comments and hidden bodies of raw HTML inside a document: one lexer, and folds over its pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from glyphloom.functions.document import HTML_TEXT, Doc

# Elements that flow inline, elements whose body is not read, void elements that part words.
INLINE = frozenset(
    "a abbr b bdi bdo cite data dfn em i mark q rp rt ruby s small span strong sub sup time u var wbr big tt ins del "
    "font nobr label img".split()
)
SKIPPED = ("pre", "code", "kbd", "samp", "script", "style")
VOID_BARRIERS = frozenset("br embed hr img input".split())
TAG = re.compile(r"<(?=[A-Za-z/!?])(?:[^<>\"']|<|\"[^\"]*\"|'[^']*')*?>", re.S)
NAME = re.compile(r"</?([A-Za-z0-9-]*)")


LEX = re.compile(r"(?P<comment><!--)|(?P<cdata><!\[cdata\[)|(?P<tag><(?=[A-Za-z/!?]))|(?P<space>\s+)|(?P<text>[^\s<]+|<)", re.I)
COMMENT = re.compile(r"<!--(?:(.*?)-->)?", re.S)
#: A slash that closes a tag at once: it ends no attribute value.
CLOSED_AT_ONCE = re.compile(r"(?:[\s\"']|^)[^\s\"'=]*/>\Z")


def tag_name(tag: str) -> str:
    """Lower-case element name of a tag; empty for declarations."""
    m = NAME.match(tag)
    return m[1].lower() if m else ""


def _tag(name: str, closing: bool) -> re.Pattern:
    return re.compile(rf"<{'/' if closing else ''}{name}(?=[>/\s]|\Z)", re.I)


OPENERS = {n: _tag(n, False) for n in (*SKIPPED, "template")}
CLOSERS = {n: _tag(n, True) for n in (*SKIPPED, "template")}


HIDING = re.compile(r"<!\[cdata\[|--!>|<template(?=[>/\s]|\Z)", re.I)
SCRIPT = re.compile(r"<(script|style)(?=[>/\s])", re.I)


class Piece(NamedTuple):
    """A stretch of the source: text, space, comment, tag, or what ends the reading; ``bad`` is the first place a browser would read otherwise."""

    kind: str
    start: int
    end: int
    name: str = ""
    bad: int | None = None


def _hiding(body: str) -> int | None:
    """First place inside a body that is not read which hides more than its end tag says."""
    spots = [m.start() for m in (HIDING.search(body),) if m]
    for n in SKIPPED:
        tags = (TAG.match(body, m.start()) for m in OPENERS[n].finditer(body))
        for t in tags:
            if t is None:
                break
            if CLOSED_AT_ONCE.search(t[0]):
                spots.append(t.start())
                break
    return min(spots, default=None)


def lex(s: str) -> Iterator[Piece]:
    """Pieces from left to right; bodies that are not read are jumped over, and what never closes ends the reading."""
    at = 0
    while m := LEX.match(s, at):
        kind, i, at = m.lastgroup, m.start(), m.end()
        if kind == "comment":
            at = s.find("-->", i + 4) + 3
            if at < 3:
                return
            odd = s.find("--!>", i + 4, at - 3)
            yield Piece(kind, i, at, bad=i if odd >= 0 else None)
        elif kind == "cdata":
            yield Piece(kind, i, len(s), bad=i)
            return
        elif kind == "tag":
            t = TAG.match(s, i)
            if t is None:
                return
            at = t.end()
            name = tag_name(t[0])
            body = None if t[0].startswith("</") else CLOSERS.get(name)
            whole = name == "template" or not CLOSED_AT_ONCE.search(t[0])
            if body is None or not whole:
                yield Piece(kind, i, at, name, i if body is not None else None)
                continue
            end = body.search(s, at)
            inner = _hiding(s[at : end.start() if end else len(s)]) if name != "template" else None
            bad = i if name == "template" else None if inner is None else at + inner
            if end is None:
                yield Piece("open", i, len(s), name, bad)
                return
            close = TAG.match(s, end.start())
            at = close.end() if close else len(s)
            yield Piece("hidden", i, at, name, bad)
        else:
            yield Piece(kind, i, at)


def visible(s: str) -> tuple[list[Piece], int | None]:
    """Text as a reader sees it (text, one space between words, and a break between blocks), and the first trouble."""
    out: list[Piece] = []
    gap: tuple[int, int] | None = None
    shown = False
    trouble: int | None = None
    for p in lex(s):
        trouble = p.bad if trouble is None else trouble
        if p.kind == "text":
            if out and out[-1].kind == "text" and out[-1].end == p.start:
                out[-1] = out[-1]._replace(end=p.end)
                continue
            if shown and gap:
                out.append(Piece("space", *gap))
            out.append(p)
            gap, shown = None, True
        elif p.kind == "space":
            gap = (gap[0] if gap else p.start, p.end)
        elif p.kind == "hidden" or p.kind == "tag" and p.name not in INLINE:
            if shown:
                out.append(Piece("block", p.start, p.start))
            gap, shown = None, False
    return out, trouble


def read_html(doc: Doc, start: int, end: int) -> None:
    """Adds comments, visible text ops, anomalies and script or style bodies of the run ``start:end``."""
    s = doc.text[start:end]
    for m in COMMENT.finditer(s):
        if m[1] is None:
            # what a comment without an end hides is not read at all
            doc.open_comment = doc.open_comment or (start + m.start(), end)
            return
        doc.comments.append((start + m.start(), start + m.end(), m[1].strip()))
    pieces, trouble = visible(s)
    if trouble is not None and doc.bad_html is None:
        doc.bad_html = (start + trouble, end)
    if any(p.kind == "text" for p in pieces):
        doc.ops.append(("block",))
        for p in pieces:
            a, b = start + p.start, start + p.end
            doc.ops.append({"text": ("text", a, b, HTML_TEXT), "space": ("own", a, b, " ", HTML_TEXT), "block": ("block",)}[p.kind])
            if p.kind != "block":
                doc.html_visible.append((a, b))
    at = 0
    while m := SCRIPT.search(s, at):
        tag = TAG.match(s, m.start())
        close = CLOSERS[m[1].lower()].search(s, tag.end()) if tag else None
        if close is None:
            doc.open_script = doc.open_script or (start + m.start(), end)
            break
        if s[tag.end() : close.start()].strip():
            doc.dropped.append((start + tag.end(), start + close.start()))
        after = TAG.match(s, close.start())
        at = after.end() if after else len(s)
