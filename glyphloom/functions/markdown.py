"""A Markdown reader that keeps source ranges: containers, leaf blocks and inlines of CommonMark, with tables,
strikethrough, footnotes, task items and front matter.

Blocks are read from line slices (a container only moves the start of its lines, so every
slice stays a range of the source).  Inlines are read over the joined slices of one leaf:
each character gets a role, and the roles are turned into text ops at the end.
"""

from __future__ import annotations

import html
import re

from glyphloom.functions.chars import PUNCT, count_words
from glyphloom.functions.document import HEADING, QUOTED, Doc, Heading, close
from glyphloom.functions.html_text import VOID_BARRIERS, read_html, tag_name

Line = tuple[int, int]

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*(.*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
DELIM = re.compile(r"(?=[^\n]{0,80}-)[ \t]{0,60}(?:\|[ \t]*)?:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*(?:\|[ \t]*)?$")
LINE_END = re.compile(r"\r\n|\n|\r")
REFDEF = re.compile(
    r" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(?:\n[ \t]*)?(<[^<>\n]*>|[^\s<][^\s]*)"
    r"(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|$)"
)
# Element names that open an HTML block of the sixth kind.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
HTML_OPEN = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}</?(?:" + "|".join(BLOCK_TAGS) + r")(?=[\s>]|/>|$)", re.I), None),
]
OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
HTML_SEVEN = re.compile(rf" {{0,3}}(?:{OPEN_TAG}|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")
INLINE_HTML = re.compile(rf"{OPEN_TAG}|</[A-Za-z][A-Za-z0-9-]*\s*>|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


#: Containers nested deeper than this are read as paragraphs.
MAX_DEPTH = 60


def unescape(s: str) -> str:
    return html.unescape(ESCAPED.sub(r"\1", s))


def label(s: str) -> str:
    return " ".join(s.split()).casefold()


class Reader:
    def __init__(self, text: str):
        self.doc = Doc(text)
        self.text = text
        self.refs: dict[str, str] = {}
        self.used: set[str] = set()
        self.defs: list[tuple[str, int, int, int, int, str, str | None]] = []
        self.notes: set[str] = {m[1] for m in re.finditer(r"^ {0,3}\[\^([^\]\s]+)\]:", text, re.M)}
        self.leaves: list[tuple] = []
        self.quote = self.depth = 0
        self.items: list[list] = []  # [has link, fresh]

    # lines

    def lines(self) -> list[Line]:
        out, at = [], 0
        for m in re.finditer(r"\r\n|\n|\r", self.text):
            out.append((at, m.start()))
            at = m.end()
        if at < len(self.text):
            out.append((at, len(self.text)))
        return out

    def s(self, line: Line) -> str:
        return self.text[line[0] : line[1]]

    def next_line(self, end: int) -> int:
        m = LINE_END.match(self.text, end)
        return m.end() if m else end

    @staticmethod
    def indent(s: str) -> int:
        col = 0
        for c in s:
            if c == " ":
                col += 1
            elif c == "\t":
                col += 4 - col % 4
            else:
                break
        return col

    @staticmethod
    def strip_indent(s: str, width: int) -> int:
        """Characters that make up at most ``width`` columns of leading white space."""
        col = k = 0
        while k < len(s) and col < width and s[k] in " \t":
            col += 1 if s[k] == " " else 4 - col % 4
            k += 1
        return k

    def read(self) -> Doc:
        lines = self.lines()
        self.collect_refs(lines)
        start = 0
        if lines and self.s(lines[0]).rstrip() == "---":
            end = next((k for k in range(1, len(lines)) if self.s(lines[k]).rstrip() in ("---", "...")), 0)
            if end > 1 and self.s(lines[1]).strip():
                self.doc.ops.append(("block",))
                for k in range(1, end):
                    self.plain(lines[k][0], self.next_line(lines[k][1]))
                start = end + 1
        self.blocks(lines[start:], True)
        for name, s, e, ds, de, dest, title in self.defs:
            if ds < de and self.text[ds:de] != dest and dest:
                self.doc.decoded.append((ds, de, dest))
            self.doc.links.append((ds, de))
            self.doc.excluded.append((s, e, "link_url"))
            if name not in self.used:
                self.doc.unused_refs.append((s, e, title))
        return close(self.doc)

    def plain(self, s: int, e: int) -> None:
        self.doc.ops.append(("text", s, e, QUOTED if self.quote else 0))
        self.doc.words += count_words(self.text[s:e])

    def collect_refs(self, lines: list[Line]) -> None:
        """Labels that definitions anywhere make known; which of them count is settled by the block pass."""
        for line in lines:
            m = re.match(r"(?:(?:[-+*]|\d{1,9}[.)])[ \t]+)?\[((?:[^\[\]\\]|\\.){1,999})\]:", self.s(line).lstrip(" \t>"))
            if m and m[1].strip() and not m[1].startswith("^"):
                self.refs.setdefault(label(m[1]), "")

    # blocks

    def opens_block(self, s: str, in_paragraph: bool) -> bool:
        if FENCE.match(s) and not (s.lstrip()[0] == "`" and "`" in FENCE.match(s)[2]):
            return True
        if ATX.match(s) or RULE.match(s) or QUOTE.match(s):
            return True
        m = ITEM.match(s)
        if m:
            empty = not s[m.end() :].strip()
            if not in_paragraph or (not empty and (m[2] in "-+*" or m[2][:-1] == "1")):
                return True
        if any(o.match(s) for o, _ in HTML_OPEN):
            return True
        return NOTE.match(s) is not None

    def blocks(self, lines: list[Line], loose: bool) -> None:
        self.depth += 1
        try:
            if self.depth > MAX_DEPTH:
                body = [x for x in lines if self.s(x).strip()]
                if body:
                    self.leaf(body, loose)
                return
            self.read_blocks(lines, loose)
        finally:
            self.depth -= 1

    def read_blocks(self, lines: list[Line], loose: bool) -> None:
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            s = self.s(line)
            if not s.strip():
                i += 1
                continue
            if self.indent(s) >= 4:
                i = self.indented(lines, i)
                continue
            m = FENCE.match(s)
            if m and not (m[1][0] == "`" and "`" in m[2]):
                i = self.fenced(lines, i, m)
                continue
            if ATX.match(s):
                self.atx(line, s)
                i += 1
                continue
            if RULE.match(s):
                self.stale()
                i += 1
                continue
            if QUOTE.match(s):
                i = self.quoted(lines, i)
                continue
            m = ITEM.match(s)
            if m:
                i = self.listing(lines, i)
                continue
            kind = next((k for k, (o, _) in enumerate(HTML_OPEN) if o.match(s)), 6 if HTML_SEVEN.match(s) else -1)
            if kind >= 0:
                i = self.html_block(lines, i, kind)
                continue
            m = NOTE.match(s)
            if m:
                i = self.note(lines, i, m)
                continue
            i = self.paragraph(lines, i, loose)

    def stale(self) -> None:
        if self.items:
            self.items[-1][1] = False

    def first_char_barrier(self, at: int) -> None:
        self.doc.ops.append(("barrier", at, min(at + 1, len(self.text)), QUOTED if self.quote else 0))

    def code_block(self, s: int, e: int, fenced: bool, info: str) -> None:
        self.first_char_barrier(s)
        self.doc.code.append((s, e, fenced, info))
        self.doc.excluded.append((s, e, "code_fence"))
        self.stale()

    def indented(self, lines: list[Line], i: int) -> int:
        j = last = i
        while j < len(lines):
            s = self.s(lines[j])
            if s.strip():
                if self.indent(s) < 4:
                    break
                last = j
            j += 1
        self.code_block(lines[i][0] + self.strip_indent(self.s(lines[i]), 4), self.next_line(lines[last][1]), False, "")
        return last + 1

    def fenced(self, lines: list[Line], i: int, m: re.Match) -> int:
        mark = m[1]
        start = lines[i][0] + m.start(1)
        closing = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        j = i + 1
        while j < len(lines) and not closing.match(self.s(lines[j])):
            j += 1
        shut = j < len(lines)
        end = lines[j][1] if shut else (self.next_line(lines[-1][1]) if len(lines) > i else lines[i][1])
        self.code_block(start, end, True, unescape(m[2].strip()))
        if not shut and not self.text[end:].strip():
            self.doc.open_fence = (start, end)
        return j + 1 if shut else len(lines)

    def atx(self, line: Line, s: str) -> None:
        m = ATX.match(s)
        a, b = m.end(), len(s.rstrip())
        tail = re.search(r"(?:^|[ \t])#+$", s[a:b])
        if tail:
            b = a + tail.start()
        b = max(a, a + len(s[a:b].rstrip()))
        self.heading(len(m[1]), line[0] + m.start(1), self.next_line(line[1]), [(line[0] + a, line[0] + b)] if b > a else [])

    def heading(self, level: int, start: int, end: int, lines: list[Line]) -> None:
        self.doc.ops.append(("block",))
        texts = self.inline(lines, HEADING)
        body = "".join(self.text[a:b] for a, b in texts).strip()
        a, b = (texts[0][0], texts[-1][1]) if texts else (start, start)
        self.doc.headings.append(Heading(level, start, end, body, a, b))

    def quoted(self, lines: list[Line], i: int) -> int:
        inner: list[Line] = []
        j = i
        while j < len(lines):
            s = self.s(lines[j])
            m = QUOTE.match(s)
            if m:
                inner.append((lines[j][0] + m.end(), lines[j][1]))
            elif s.strip() and inner and self.lazy(inner) and not self.opens_block(s, True):
                inner.append(lines[j])
            else:
                break
            j += 1
        self.doc.ops.append(("block",))
        self.quote += 1
        self.blocks(inner, True)
        self.quote -= 1
        return j

    def lazy(self, inner: list[Line]) -> bool:
        """Whether the last line of a container leaves a paragraph open."""
        s = self.s(inner[-1])
        while (m := QUOTE.match(s)) or (m := ITEM.match(s)):
            s = s[m.end() :].lstrip(" ") if m.re is ITEM else s[m.end() :]
        if not s.strip() or self.indent(s) >= 4 and len(inner) == 1:
            return False
        return not (FENCE.match(s) or ATX.match(s) or RULE.match(s) or any(o.match(s) for o, _ in HTML_OPEN))

    def listing(self, lines: list[Line], i: int) -> int:
        m = ITEM.match(self.s(lines[i]))
        kind = m[2][-1]
        items: list[tuple[int, list[Line]]] = []
        j, n = i, len(lines)
        blank_between = False
        while j < n:
            s = self.s(lines[j])
            m = ITEM.match(s)
            if not m or m[2][-1] != kind or (RULE.match(s) and items):
                break
            gap = s[m.end() :]
            pad = self.indent(gap)
            taken = pad if 1 <= pad <= 4 and gap.strip() else 1
            width = len(m[1]) + len(m[2]) + taken
            inner = [(lines[j][0] + min(len(s), m.end() + self.strip_indent(gap, taken)), lines[j][1])]
            start = lines[j][0] + len(m[1])
            j += 1
            blanks = 0
            while j < n:
                s = self.s(lines[j])
                if not s.strip():
                    inner.append((lines[j][1], lines[j][1]))
                    blanks += 1
                    j += 1
                    continue
                if self.indent(s) >= width:
                    if blanks and len(inner) == blanks + 1 and not self.s(inner[0]).strip():
                        break
                    inner.append((lines[j][0] + self.strip_indent(s, width), lines[j][1]))
                    blanks = 0
                    j += 1
                    continue
                if not blanks and not ITEM.match(s) and not self.opens_block(s, True) and self.lazy(inner):
                    inner.append(lines[j])
                    j += 1
                    continue
                break
            for _ in range(blanks):
                inner.pop()
            items.append((start, inner))
            m = ITEM.match(self.s(lines[j])) if j < n else None
            if blanks and m and m[2][-1] == kind:
                blank_between = True
        loose = blank_between or any(self.split_by_blank(x) for _, x in items)
        for _, inner in items:
            self.doc.ops.append(("block",))
            self.doc.bullets += 1
            self.items.append([False, True])
            t = re.match(r"\[[ xX]\][ \t]", self.s(inner[0]))
            if t:
                self.doc.task_bullets += 1
                inner = [(inner[0][0] + t.end(), inner[0][1]), *inner[1:]]
            self.blocks(inner, loose)
            if self.items.pop()[0]:
                self.doc.linked_bullets += 1
            self.stale()
        return j

    def split_by_blank(self, inner: list[Line]) -> bool:
        return any(not self.s(x).strip() for x in inner[1:-1]) and not any(FENCE.match(self.s(x)) for x in inner)

    def html_block(self, lines: list[Line], i: int, kind: int) -> int:
        j = i
        if kind < 5:
            stop = HTML_OPEN[kind][1]
            while j < len(lines) and not stop.search(self.s(lines[j])):
                j += 1
            j = min(j + 1, len(lines))
        else:
            while j < len(lines) and self.s(lines[j]).strip():
                j += 1
        s, e = lines[i][0], self.next_line(lines[j - 1][1])
        self.doc.html.append((s, e))
        self.doc.excluded.append((s, e, "html"))
        read_html(self.doc, s, e)
        self.stale()
        return j

    def note(self, lines: list[Line], i: int, m: re.Match) -> int:
        inner = [(lines[i][0] + m.end(), lines[i][1])]
        j = i + 1
        while j < len(lines):
            s = self.s(lines[j])
            if s.strip() and self.indent(s) < 4 and (self.opens_block(s, True) or not self.s(lines[j - 1]).strip()):
                break
            inner.append((lines[j][0] + self.strip_indent(s, 4), lines[j][1]))
            j += 1
        self.doc.ops.append(("block",))
        self.blocks(inner, True)
        return j

    def paragraph(self, lines: list[Line], i: int, loose: bool) -> int:
        j = i + 1
        level = 0
        while j < len(lines):
            s = self.s(lines[j])
            if not s.strip():
                break
            m = SETEXT.match(s)
            if m:
                level = 1 if m[1][0] == "=" else 2
                break
            if self.opens_block(s, True) or (DELIM.match(s) and "|" in s + self.s(lines[j - 1]) and "-" in s and self.table_fits(lines[j - 1], s)):
                break
            j += 1
        body = lines[i:j]
        body = self.take_refs(body)
        if level and body:
            self.heading(level, body[0][0] + len(self.s(body[0])) - len(self.s(body[0]).lstrip()), self.next_line(lines[j][1]), body)
            return j + 1
        if level and not body:
            body = [lines[j]]
            j += 1
        if not body:
            return j
        if j < len(lines) and DELIM.match(self.s(lines[j])) and self.table_fits(body[-1], self.s(lines[j])):
            if body[:-1]:
                self.leaf(body[:-1], loose)
            return self.table(lines, body[-1], j)
        self.leaf(body, loose)
        return j

    def leaf(self, body: list[Line], loose: bool) -> None:
        if loose:
            self.doc.ops.append(("block",))
        before = self.doc.words
        self.inline(body, 0)
        if loose:
            self.doc.paragraph_words.append(self.doc.words - before)

    def take_refs(self, body: list[Line]) -> list[Line]:
        """Takes the reference definitions off the front of a paragraph.  Lines that run on are read as one text, others one by one."""
        # the last line after which the text does not run on into the next one
        gap = next((i for i in range(len(body) - 2, -1, -1) if self.next_line(body[i][1]) != body[i + 1][0]), -1)
        k = 0
        while k < len(body):
            at = body[k][0]
            m = REFDEF.match(self.text, at, body[-1][1] if k > gap else body[k][1])
            if not m or not m[1].strip() or m[1].startswith("^"):
                break
            ds, de, dest = m.start(2), m.end(2), m[2]
            if dest.startswith("<"):
                ds, de, dest = ds + 1, de - 1, dest[1:-1]
            title = unescape(m[3][1:-1]) if m[3] is not None else None
            lead = at
            while self.text[lead] == " ":
                lead += 1
            self.defs.append((label(m[1]), lead, m.end(), ds, de, unescape(dest), title))
            while k < len(body) and body[k][0] <= m.end():
                k += 1
        return body[k:]

    # tables

    def cells(self, line: Line) -> list[Line]:
        s = self.s(line)
        cuts = [m.start() for m in re.finditer(r"(?<!\\)\|", s)]
        spans, at = [], 0
        for c in [*cuts, len(s)]:
            spans.append((at, c))
            at = c + 1
        if spans and not s[spans[0][0] : spans[0][1]].strip():
            spans = spans[1:]
        if spans and not s[spans[-1][0] : spans[-1][1]].strip():
            spans = spans[:-1]
        return [(line[0] + a, line[0] + b) for a, b in spans]

    def table_fits(self, head: Line, delim: str) -> bool:
        h = self.s(head)
        if "|" not in h and "|" not in delim:
            return False
        return len(self.cells(head)) == len([x for x in delim.strip().strip("|").split("|")])

    def table(self, lines: list[Line], head: Line, j: int) -> int:
        self.first_char_barrier(head[0])
        rows = [head]
        j += 1
        while j < len(lines) and self.s(lines[j]).strip() and not self.opens_block(self.s(lines[j]), True):
            rows.append(lines[j])
            j += 1
        width = len(self.cells(head))
        for row in rows:
            for a, b in self.cells(row)[:width]:
                self.doc.ops.append(("block",))
                t = self.text[a:b]
                a2 = a + len(t) - len(t.lstrip())
                b2 = max(a2, a + len(t.rstrip()))
                if b2 > a2:
                    self.inline([(a2, b2)], 0)
                self.first_char_barrier(b)
        return j

    # inlines

    def inline(self, lines: list[Line], flags: int) -> list[Line]:
        """Reads the inlines of a leaf into ops; returns the ranges of its text runs."""
        buf: list[str] = []
        pos: list[int] = []
        hard: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(lines):
            t = self.text[a:b]
            a += len(t) - len(t.lstrip(" \t"))
            t = self.text[a:b]
            last = k == len(lines) - 1
            cut = len(t.rstrip(" \t"))
            if not last:
                if len(t) - cut >= 2 and t[cut:].startswith("  "):
                    hard[len(buf) + cut] = (a + cut, self.next_line(b))
                elif t[:cut].endswith("\\") and not t[:cut].endswith("\\\\"):
                    cut -= 1
                    hard[len(buf) + cut] = (a + cut, self.next_line(b))
            buf.extend(t[:cut])
            pos.extend(range(a, a + cut))
            if not last:
                buf.append("\n")
                pos.append(b)
        pos.append((pos[-1] + 1) if pos else (lines[0][0] if lines else 0))
        return Inline(self, "".join(buf), pos, hard, flags | (QUOTED if self.quote else 0)).run()


class Inline:
    def __init__(self, reader: Reader, buf: str, pos: list[int], hard: dict, flags: int):
        self.r, self.b, self.pos, self.hard, self.flags = reader, buf, pos, hard, flags
        self.role = bytearray(b"T" * len(buf))
        self.barrier: dict[int, list[Line]] = {}
        self.delims: list[list] = []  # [start, end, char, can open, can close, left, right of unused]
        self.brackets: list[list] = []  # [position, is image, delimiter bottom, active]
        self.spans: list[tuple[int, int, bool]] = []
        self.htmls: list[Line] = []

    def src(self, a: int, b: int) -> Line:
        return (self.pos[a], self.pos[b - 1] + 1 if b > a else self.pos[a])

    def mark(self, a: int, b: int, role: str) -> None:
        self.role[a:b] = role.encode() * (b - a)

    def run(self) -> list[Line]:
        b, n, i = self.b, len(self.b), 0
        doc = self.r.doc
        while i < n:
            c = b[i]
            if c == "\\" and i + 1 < n and b[i + 1] in PUNCT:
                i += 2
            elif c == "`":
                i = self.code(i)
            elif c == "<":
                i = self.angle(i)
            elif c == "!" and b[i + 1 : i + 2] == "[":
                self.brackets.append([i, True, len(self.delims), True])
                i += 2
            elif c == "[":
                m = re.compile(r"\[\^([^\]\s]+)\]").match(b, i)
                if m and m[1] in self.r.notes:
                    self.barrier.setdefault(i, []).append(self.src(i, m.end()))
                    self.mark(i, m.end(), "S")
                    i = m.end()
                    continue
                self.brackets.append([i, False, len(self.delims), True])
                i += 1
            elif c == "]":
                i = self.shut(i)
            elif c in "*_~":
                j = i
                while j < n and b[j] == c:
                    j += 1
                before = b[i - 1] if i else "\n"
                after = b[j] if j < n else "\n"
                ws_a, ws_b = after.isspace(), before.isspace()
                p_a, p_b = self.punct(after), self.punct(before)
                left = not ws_a and (not p_a or ws_b or p_b)
                right = not ws_b and (not p_b or ws_a or p_a)
                if c == "_":
                    opens, closes = left and (not right or p_b), right and (not left or p_a)
                else:
                    opens, closes = left, right
                if c == "~" and j - i > 2:
                    opens = closes = False
                self.delims.append([i, j, c, opens, closes, j - i])
                i = j
            else:
                i += 1
        self.emphasis(0)
        runs = self.emit()
        if self.r.items and self.r.items[-1][1] and not (self.flags & HEADING):
            self.bold_label()
        for a, e in self.htmls:
            read_html(doc, a, e)
        return runs

    @staticmethod
    def punct(c: str) -> bool:
        import unicodedata

        return c in PUNCT or (c >= "\x80" and unicodedata.category(c)[0] in "PS")

    def code(self, i: int) -> int:
        j = i
        while j < len(self.b) and self.b[j] == "`":
            j += 1
        size = j - i
        for m in re.compile("`+").finditer(self.b, j):
            if m.end() - m.start() == size:
                self.mark(i, m.end(), "C")
                s, e = self.src(i, m.end())
                self.r.doc.excluded.append((s, e, "inline_code"))
                self.r.doc.code.append((s, e, False, ""))
                self.barrier.setdefault(i, []).append((s, e))
                return m.end()
        return j

    def angle(self, i: int) -> int:
        m = AUTOLINK.match(self.b, i)
        if m:
            s, e = self.src(i + 1, m.end() - 1)
            self.mark(i, m.end(), "A")
            doc = self.r.doc
            doc.excluded.append((s, e, "autolink"))
            doc.links.append((s, e))
            self.barrier.setdefault(i, []).append((s, e))
            if self.r.items:
                self.r.items[-1][0] = True
            return m.end()
        m = INLINE_HTML.match(self.b, i)
        if not m:
            return i + 1
        s, e = self.src(i, m.end())
        self.mark(i, m.end(), "H")
        doc = self.r.doc
        doc.html.append((s, e))
        doc.excluded.append((s, e, "html"))
        if not m[0].startswith("</") and tag_name(m[0]) in VOID_BARRIERS:
            self.barrier.setdefault(i, []).append((s, e))
        if self.htmls and self.htmls[-1][1] == s:
            self.htmls[-1] = (self.htmls[-1][0], e)
        else:
            self.htmls.append((s, e))
        return m.end()

    def shut(self, i: int) -> int:
        if not self.brackets:
            return i + 1
        at, image, bottom, active = self.brackets.pop()
        if not active:
            return i + 1
        b, r, doc = self.b, self.r, self.r.doc
        m = re.compile(
            r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*)?)"
            r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)"
        ).match(b, i + 1)
        end = -1
        if m:
            g = 1 if m[1] is not None else 2
            end = m.end()
            if m[g]:
                s, e = self.src(m.start(g), m.end(g))
                raw, dest = r.text[s:e], unescape(m[g])
                doc.excluded.append((s, e, "link_url"))
                doc.links.append((s, e))
                if raw != dest and dest:
                    doc.decoded.append((s, e, dest))
        else:
            inner = b[at + (2 if image else 1) : i]
            m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(b, i + 1)
            name = label(m[1]) if m and m[1].strip() else label(inner)
            if name in r.refs:
                end = m.end() if m else i + 1
                r.used.add(name)
            elif m and not m[1].strip() and label(inner) in r.refs:
                end = m.end()
                r.used.add(label(inner))
        if end < 0:
            return i + 1
        opener = 2 if image else 1
        self.emphasis(bottom)
        del self.delims[bottom:]
        self.mark(at, at + opener, "S")
        self.mark(i, end, "S")
        if image:
            s, e = self.src(at, end)
            self.barrier.setdefault(at, []).append((s, min(s + 2, e)))
            self.barrier.setdefault(end - 1, []).append((e - 1, e))
        else:
            for x in self.brackets:
                if not x[1]:
                    x[3] = False
            if r.items:
                r.items[-1][0] = True
        return end

    def emphasis(self, bottom: int) -> None:
        d = self.delims
        k = bottom
        while k < len(d):
            closer = d[k]
            if not closer[4] or not closer[5]:
                k += 1
                continue
            j = k - 1
            while j >= bottom:
                opener = d[j]
                if opener[2] == closer[2] and opener[3] and opener[5]:
                    if closer[2] == "~":
                        if opener[5] == closer[5]:
                            break
                    elif not ((opener[4] or closer[3]) and (opener[1] - opener[0] + closer[1] - closer[0]) % 3 == 0 and not ((opener[1] - opener[0]) % 3 == 0 and (closer[1] - closer[0]) % 3 == 0)):
                        break
                j -= 1
            if j < bottom:
                k += 1
                continue
            opener = d[j]
            use = closer[5] if closer[2] == "~" else (2 if opener[5] >= 2 and closer[5] >= 2 else 1)
            o_end = opener[0] + opener[5]
            c_start = closer[1] - closer[5]
            self.mark(o_end - use, o_end, "S")
            self.mark(c_start, c_start + use, "S")
            if closer[2] != "~":
                self.spans.append((o_end - use, c_start + use, use == 2))
            opener[5] -= use
            closer[5] -= use
            for x in d[j + 1 : k]:
                x[5] = 0
            if not closer[5]:
                k += 1

    def emit(self) -> list[Line]:
        doc, pos, b, role, flags = self.r.doc, self.pos, self.b, self.role, self.flags
        for a, e, strong in sorted(self.spans, key=lambda x: (x[0], -x[1])):
            s, t = self.src(a, e)
            doc.emphasis.append((s, t, self.r.text[s:t].strip("*_")))
            if strong:
                doc.strong.append((s, t))
        runs: list[Line] = []
        n, i = len(b), 0
        while i < n:
            for s, e in self.barrier.get(i, ()):
                doc.ops.append(("barrier", s, e, flags))
            if role[i] != 84:
                i += 1
                continue
            if b[i] == "\n":
                if i in self.hard:
                    s, e = self.hard[i]
                    doc.ops.append(("break", s, e, True, flags))
                else:
                    doc.ops.append(("break", pos[i], self.r.next_line(pos[i]), False, flags))
                i += 1
                continue
            j = i + 1
            while j < n and role[j] == 84 and b[j] != "\n" and j not in self.barrier and pos[j] == pos[j - 1] + 1:
                j += 1
            s, e = pos[i], pos[j - 1] + 1
            doc.ops.append(("text", s, e, flags))
            doc.words += count_words(self.r.text[s:e])
            runs.append((s, e))
            i = j
        return runs

    def bold_label(self) -> None:
        """A strong run that opens a list item and ends with, or is followed by, a colon."""
        item = self.r.items[-1]
        text = self.r.text
        first = next((i for i in range(len(self.b)) if self.role[i] != 83 and not self.b[i].isspace()), None)
        if first is None:
            return
        item[1] = False
        for a, e, strong in self.spans:
            if strong and a <= first < e and self.role[first] == 84:
                s, t = self.src(a, e)
                if text[s:t].rstrip("*_").rstrip().endswith(":"):
                    self.r.doc.labels.append((s, t))
                else:
                    nxt = next((i for i in range(e, len(self.b)) if self.role[i] != 83), None)
                    if nxt is not None and self.role[nxt] == 84 and self.b[nxt:].lstrip().startswith(":"):
                        self.r.doc.labels.append((s, t))
                return


MARKER = re.compile(r"\s*(?:[-*+>•‣⁃∙]|#+|\d+[.)])\s+")


def read_text(text: str) -> Doc:
    """Plain-text reading: every non-blank line is a block, its leading marker is structure."""
    doc = Doc(text)
    words = 0
    at = 0
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
        if m.start() == m.end():
            continue
        line = m[0].rstrip("\n").rstrip("\r")
        at = m.start()
        if not line.strip():
            if words:
                doc.paragraph_words.append(words)
            words = 0
            continue
        doc.ops.append(("block",))
        k = MARKER.match(line)
        doc.ops.append(("text", at + (k.end() if k else 0), at + len(line), 0))
        head = line.lstrip()
        if head.startswith(("- ", "* ", "+ ")):
            doc.bullets += 1
            doc.linked_bullets += "](" in head or "http" in head
        w = count_words(line)
        doc.words += w
        words += w
    if words:
        doc.paragraph_words.append(words)
    return close(doc)


def read_markdown(text: str) -> Doc:
    return Reader(text).read()

