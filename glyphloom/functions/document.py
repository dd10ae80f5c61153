"""What extraction knows about one document; offsets are code points of the payload."""

from __future__ import annotations

from dataclasses import dataclass, field

QUOTED, HEADING, HTML_TEXT, FULL_FOLD = 1, 2, 32, 64


@dataclass
class Heading:
    level: int
    start: int
    end: int
    text: str
    text_start: int
    text_end: int


@dataclass
class Doc:
    text: str
    #: ("block",) | ("text", s, e, flags) | ("own", s, e, content, flags) | ("break", s, e, hard, flags) | ("barrier", s, e, flags)
    ops: list[tuple] = field(default_factory=list)
    excluded: list[tuple[int, int, str]] = field(default_factory=list)
    headings: list[Heading] = field(default_factory=list)
    code: list[tuple[int, int, bool, str]] = field(default_factory=list)
    comments: list[tuple[int, int, str]] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)
    decoded: list[tuple[int, int, str]] = field(default_factory=list)
    emphasis: list[tuple[int, int, str]] = field(default_factory=list)
    strong: list[tuple[int, int]] = field(default_factory=list)
    labels: list[tuple[int, int]] = field(default_factory=list)
    unused_refs: list[tuple[int, int, str | None]] = field(default_factory=list)
    dropped: list[tuple[int, int]] = field(default_factory=list)
    paragraph_words: list[int] = field(default_factory=list)
    words: int = 0
    bullets: int = 0
    linked_bullets: int = 0
    task_bullets: int = 0
    html: list[tuple[int, int]] = field(default_factory=list)
    html_visible: list[tuple[int, int]] = field(default_factory=list)
    open_fence: tuple[int, int] | None = None
    open_comment: tuple[int, int] | None = None
    open_script: tuple[int, int] | None = None
    bad_html: tuple[int, int] | None = None
    bad_reference: tuple[int, int] | None = None
    prose: list[tuple[int, int, int]] = field(default_factory=list)
    regions: list[tuple[int, int, str]] = field(default_factory=list)
    sections: list[tuple[str, int, int, int]] = field(default_factory=list)


def close(doc: Doc) -> Doc:
    """Reference anomalies, prose runs, the total segmentation and the section tree."""
    from glyphloom.functions.chars import LOOSE_REF, entity, numeric_ref

    text = doc.text
    for op in doc.ops:
        if op[0] != "text" or "&" not in text[op[1] : op[2]]:
            continue
        html = bool(op[3] & HTML_TEXT)
        piece = text[op[1] : op[2]]
        i = piece.find("&")
        while i >= 0 and doc.bad_reference is None:
            known = entity(piece, i)
            step, bad = 1, False
            if known:
                step = known[0]
            else:
                verdict, size, _ = numeric_ref(piece, i)
                if verdict == "literal":
                    m = LOOSE_REF.match(piece, i)
                    if m:
                        step, bad = m.end() - i, html
                else:
                    step, bad = size, verdict == "suppress" or (verdict == "overlong" and html)
            if bad:
                doc.bad_reference = (op[1] + i, op[1] + i + step)
                break
            i = piece.find("&", i + step)
        if doc.bad_reference:
            break
    for op in doc.ops:
        if op[0] in ("text", "own") and op[1] < op[2]:
            flags = op[-1]
            if doc.prose and doc.prose[-1][1] == op[1] and doc.prose[-1][2] == flags:
                doc.prose[-1] = (doc.prose[-1][0], op[2], flags)
            else:
                doc.prose.append((op[1], op[2], flags))
    at = 0
    for s, e, kind in sorted([*((s, e, "prose") for s, e, _ in doc.prose), *doc.excluded], key=lambda r: (r[0], r[1])):
        s = max(s, at)
        if s >= e:
            continue
        if s > at:
            doc.regions.append((at, s, "structure"))
        doc.regions.append((s, e, kind))
        at = e
    if at < len(text):
        doc.regions.append((at, len(text), "structure"))
    # from the last heading back: where the next heading of each level stands
    following = [len(text)] * 7
    for h in reversed(doc.headings):
        doc.sections.append((h.text, h.level, h.start, min(following[: h.level + 1])))
        following[h.level] = h.start
    doc.sections.reverse()
    return doc
