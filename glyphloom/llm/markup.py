"""Markup residue to clean text (problem 1).

``convert`` turns a text with HTML, Markdown, wiki or LaTeX markup into clean text
in which headings (``## ``), list items (``- ``), code blocks (fenced, with their
language) and formulas (``$..$``) stay marked, and names the kinds of element seen.

The whole document goes through the standard-library HTML parser as one stream; its events carry their line.
From them every line gets its text-to-tag ratio (characters of text for each tag, template or command); a Gaussian
smooths the ratios along the lines, two-means clustering parts them, and the midpoint of the two clusters
is the threshold.  Lines of markup under it (bars, menus, wrappers) leave the text with what little text they hold.
Headings, list items, table cells, code and formulas stay wherever they stand, and so does a line without any markup.

Defined results: null text gives null clean text and no element; an empty text
stays empty; text without markup is returned as it is (line ends become ``\n``).
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

KINDS = ("heading", "list", "code", "formula", "other")

# Element names of HTML and of wiki extensions.
HTML_TAGS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center "
    "cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map "
    "mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s "
    "samp script section select small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr ref references nowiki gallery syntaxhighlight "
    "mi mn mo mrow msup msub mfrac msqrt mtext noinclude includeonly poem".split()
)
BREAKING = frozenset(
    "p div section article aside header footer main nav table tr caption ul ol dl dd dt li blockquote br hr h1 h2 h3 h4 "
    "h5 h6 figure figcaption form address body html head title pre".split()
)
LIST_TAGS = frozenset("ul ol li dl dt dd menu dir".split())
HEAD_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# LaTeX environments and sectioning commands.
CODE_ENVS = "lstlisting|verbatim\\*?|Verbatim|minted|alltt|listing|algorithmic"
MATH_ENVS = "equation\\*?|align\\*?|gather\\*?|multline\\*?|eqnarray\\*?|displaymath|math|flalign\\*?|alignat\\*?"
LIST_ENVS = "itemize|enumerate|description"
SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}

OPEN, SHUT = "\ue000", "\ue001"
TOKEN = re.compile("\ue000(\\d+)\ue001")
#: A text without any of these has no markup.
HINT = re.compile(r"[<>&*_`~$\\|\[{=#+^]|''|^[ \t]*[-•][ \t]|^[ \t]*\d{1,3}[.)][ \t]|^(?: {4}|\t)|^[ \t]*[-_]{2,}[ \t]*$|^%", re.M)

OPENER = re.compile(
    r"^ {0,3}(?P<fence>`{3,}|~{3,})(?P<info>[^\n]*)$"
    r"|\\begin\{(?P<env>" + CODE_ENVS + "|" + MATH_ENVS + r")\}(?P<opt>(?:\[[^\]\n]*\]|\{[^}\n]*\})*)"
    r"|<(?P<tag>pre|source|syntaxhighlight|code|math)\b(?P<attr>[^<>]*)>"
    r"|<(?P<span>span)\b(?P<sattr>[^<>]*)>"
    r"|(?P<dd>\$\$)|(?P<br>\\\[)|(?P<pa>\\\()"
    r"|(?<![\\$\w])\$(?P<ibody>(?! )[^$\n]+?(?<! ))\$(?![\d$])"
    r"|(?<!`)(?P<tick>`{1,2})(?!`)",
    re.M | re.I,
)
MATH_CLASS = re.compile(r"class=[\"']?[^\"'>]*\bmath\b", re.I)
MATH_ENV = re.compile("(?:" + MATH_ENVS + ")$")
MATHY = re.compile(r"[\\^_=+<>/]|^[A-Za-z]$|^-?\d+$|[A-Za-z]\s*[-*]\s*[A-Za-z\d]")
LISTING_LANGUAGE = re.compile(r"language\s*=\s*\{?([\w+#.-]+)", re.I)
TAG_LANGUAGE = re.compile(r"(?:lang(?:uage)?|class)\s*=\s*[\"']?(?:language-|lang-)?([\w+#.-]+)", re.I)

ATX = re.compile(r"(#{1,6})[ \t]+(?=\S)")
WIKI_HEAD = re.compile(r"(={1,6})(?=[^=])(?=.*[^=\s])(?:.*[^=])\1$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
BULLET = re.compile(r"^([ \t]*)([-+•]|\*{1,6}|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
HASHES = re.compile(r"^(#{1,6})[ \t]+(\S.*)$")
SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
LIST_ENV = re.compile(r"\\(?:begin|end)\{(?:" + LIST_ENVS + r")\}(?:\[[^\]\n]*\])?")
ITEM = re.compile(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*(.*)$")
TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
WIKI_TABLE = re.compile(r"^[ \t]*(\{\||\|\}|\|-|\|\+|!)(.*)$")
QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
REFERENCE = re.compile(r"^ {0,3}\[(\^?[^\]\n]+)\]:[ \t]*(.*)$")
COMMENT_LINE = re.compile(r"^%.*$")

INLINE = [
    (re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\n]*?[\"'])?\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n]+)\]\([^()\s]+(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\n]*?[\"'])?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"), r"\1"),
    (re.compile(r"\{\{[^{}\n]*\}\}"), ""),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
    (re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    (re.compile(r"'{5}(?!')(.+?)(?<!')'{5}"), r"\1"),
    (re.compile(r"'{3}(?!')(.+?)(?<!')'{3}"), r"\1"),
    (re.compile(r"''(?!')(.+?)(?<!')''"), r"\1"),
    (re.compile(r"(?<![\w*])\*{1,3}(?=[^\s*])([^*\n]*[^\s*])\*{1,3}(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])_{1,3}(?=[^\s_])([^_\n]*(?:_[^_\n]+)*?[^\s_])_{1,3}(?![\w_])"), r"\1"),
    (re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    (re.compile(r"==(?=[^\s=])([^=\n]+?)(?<=[^\s=])==(?!=)"), r"\1"),
    (re.compile(r"\\(?:footnote|footnotetext|thanks)\{[^{}\n]*\}"), ""),
    (re.compile(r"~?\\(?:cite[a-zA-Z]*|ref|eqref|autoref|pageref|label|bibitem|index)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), ""),
    (re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\(?:documentclass|usepackage|begin|end|bibliography|bibliographystyle|pagestyle|input|include|includegraphics)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:maketitle|tableofcontents|noindent|newpage|clearpage|centering|bigskip|medskip|smallskip|par)\b"), ""),
    (re.compile(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])*\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\{\\[a-z]{2,}[ \t]+([^{}\n]*)\}"), r"\1"),
]
INLINE_HINT = re.compile(r"[\[{*_~\\=]|''|<(?:https?|ftp|mailto):")
ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")


@dataclass
class Converted:
    """Clean text, kinds seen, structural elements in the order found, share of content lines."""

    text: str | None
    kinds: set[str] = field(default_factory=set)
    elements: list[tuple[str, str]] = field(default_factory=list)
    content_share: float = 1.0

    def add(self, kind: str, info: str = "") -> None:
        self.kinds.add(kind)
        if kind != "other":
            self.elements.append((kind, info))


#: A tag, comment or declaration as it stands in the source.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<(/?)([a-zA-Z][\w-]*)\b[^<>]*>", re.S | re.I)
#: Templates and commands, the tags of wiki and LaTeX text.
COMMANDS = re.compile(r"\{\{[^{}\n]*\}\}|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
#: Elements whose body is read only up to their end tag; without one they are read as any other.
CLOSED = frozenset("script style title textarea iframe xmp noembed noframes plaintext noscript".split())
HIDDEN = frozenset(("script", "style"))
KEEPING = LIST_TAGS | HEAD_TAGS | frozenset("table tr td th caption pre blockquote".split())
#: Source lines that are structure of their own.
STRUCTURAL = re.compile(
    r"^ {0,3}(?:#{1,6}[ \t]|=|-{2,}|>|\[|\*[ \t]|\||!)|^[ \t]*(?:[-+•*]|\*{1,6}|\d{1,3}[.)])[ \t]|\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|item|begin|end)\b|\ue000"
)
LESS, AMPERSAND = "\ue004", "\ue005"
#: Least distance of the clusters, in natural logarithms of characters a tag; nearer ones are one cluster.
APART = 1.0
#: A line with more characters a tag is content whatever the clusters say: where all lines are long, their midpoint lies among sentences.
SPARSE = 10.0


class _Events(HTMLParser):
    """The document as (line, text) parts with line breaks, heading and list marks; tags counted by line."""

    def __init__(self, out: Converted, lines: int):
        super().__init__(convert_charrefs=False)
        self.doc = out
        self.parts: list[tuple[int, str, bool]] = []
        self.tags = [0] * lines
        self.chars = [0] * lines
        self.keep = [False] * lines
        self.depth = 0

    def line(self) -> int:
        return min(self.getpos()[0], len(self.tags)) - 1

    def mark(self, text: str, structure: bool) -> None:
        at = self.line()
        self.tags[at] += 1
        self.keep[at] = self.keep[at] or structure
        if text:
            self.parts.append((at, text, True))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        structure = tag in KEEPING
        self.depth += structure and tag not in ("li", "dt", "dd")
        if tag in HEAD_TAGS:
            self.doc.add("heading", tag[1])
            self.mark("\n" + "#" * int(tag[1]) + "\ue002", True)
        elif tag in LIST_TAGS:
            self.doc.add("list")
            self.mark("\n-\ue002" if tag in ("li", "dt", "dd") else "", True)
        else:
            self.doc.add("other")
            self.mark(("\n" if tag == "br" else "\n\n") if tag in BREAKING else " " if tag in ("td", "th") else "", structure)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.depth -= tag in KEEPING and tag not in ("li", "dt", "dd")

    def handle_endtag(self, tag: str) -> None:
        structure = tag in KEEPING
        self.depth = max(0, self.depth - (structure and tag not in ("li", "dt", "dd")))
        if tag in HEAD_TAGS:
            self.doc.kinds.add("heading")
            self.mark("\ue003\n", True)
        elif tag in LIST_TAGS:
            self.doc.kinds.add("list")
            self.mark("\n" if tag in ("ul", "ol", "dl") else "", True)
        else:
            self.doc.add("other")
            self.mark("\n\n" if tag in BREAKING else "", structure)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in HIDDEN:
            data = "\n" * data.count("\n")
        at = self.line()
        for k, piece in enumerate(data.split("\n")):
            here = min(at + k, len(self.tags) - 1)
            if k:
                self.parts.append((here, "\n", True))
            if piece:
                commands = COMMANDS.findall(piece)
                self.tags[here] += len(commands)
                self.chars[here] += len(piece.strip()) - sum(map(len, commands))
                self.keep[here] = self.keep[here] or self.depth > 0
                self.parts.append((here, piece, False))

    def handle_comment(self, data: str) -> None:
        self.doc.add("other")
        self.mark("", False)
        self.parts.append((self.line(), "\n" * data.count("\n"), True))

    def handle_decl(self, decl: str) -> None:
        self.doc.add("other")
        self.mark("", False)


def event_source(text: str) -> str:
    """The text as the parser reads it: bare names in known tags, every other ``<`` and every ``&`` put aside as characters."""
    parts: list[str] = []
    at = 0
    closers: dict[str, int] = {}
    for m in MARKUP.finditer(text):
        name = (m[2] or "").lower()
        if name and (name not in HTML_TAGS or m[0].lower().startswith(("<http:", "<https:"))):
            continue
        parts.append(text[at : m.start()].replace("<", LESS))
        at = m.end()
        breaks = "\n" * m[0].count("\n")
        if not name:
            comment = m[0][4:].removesuffix("-->").replace("-->", "").replace("--!>", "") if m[0].startswith("<!--") else None
            parts.append(f"<!--{breaks if comment is not None else ''} -->" if comment is not None else f"<!DOCTYPE html{breaks}>")
            continue
        if name in CLOSED and not m[1]:
            if name not in closers:
                found = [x.start() for x in re.finditer(rf"</{name}\b[^<>]*>", text, re.I)]
                closers[name] = found[-1] if found else -1
            if closers[name] < m.start():
                name = "span"
        parts.append(f"<{m[1]}{name}{breaks}>")
    parts.append(text[at:].replace("<", LESS))
    return "".join(parts).replace("&", AMPERSAND)


def content_lines(chars: list[int], tags: list[int], sigma: float = 1.0) -> list[bool]:
    """Content flags of the lines: text-to-tag ratios, own or smoothed, against the midpoint of their two clusters.

    The threshold is never above ``SPARSE`` characters a tag.  Blank lines take no part.  Without tags, or where the clusters lie closer than ``APART``, every line is content.
    """
    full = [i for i, (c, t) in enumerate(zip(chars, tags, strict=True)) if c > 0 or t]
    flags = [True] * len(chars)
    if not any(tags) or len(full) < 2:
        return flags
    ratio = [math.log1p(max(0, chars[i]) / max(1, tags[i])) for i in full]
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratio)):
        lo, hi = max(0, i - reach), min(len(ratio), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        smooth.append(sum(a * b for a, b in zip(w, ratio[lo:hi], strict=True)) / sum(w))
    low, high = min(smooth), max(smooth)
    for _ in range(12):
        cut = (low + high) / 2
        under = [x for x in smooth if x <= cut]
        over = [x for x in smooth if x > cut]
        if not under or not over:
            break
        low, high = sum(under) / len(under), sum(over) / len(over)
    if high - low < APART:
        return flags
    cut = min((low + high) / 2, math.log1p(SPARSE))
    for i, s, r in zip(full, smooth, ratio, strict=True):
        flags[i] = s > cut or r > cut
    return flags


def _language(info: str) -> str:
    m = re.match(r"[\s{.`~]*(?:language-|lang-)?([A-Za-z][\w+#-]*)", info or "")
    return m[1].lower() if m else ""


def _tidy(body: str) -> str:
    return body.strip("\n").rstrip()


def convert(text: str | None) -> Converted:
    if text is None:
        return Converted(None)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out = Converted(text)
    if not HINT.search(text):
        return out
    kept: list[str] = []
    plain = text.replace(OPEN, "").replace(SHUT, "")

    def hold(s: str) -> str:
        kept.append(s)
        return f"{OPEN}{len(kept) - 1}{SHUT}"

    def code(body: str, lang: str) -> str:
        out.add("code", lang)
        return "\n" + hold(f"```{lang}\n{_tidy(body)}\n```") + "\n"

    def formula(body: str, block: bool) -> str:
        out.add("formula")
        body = re.sub(r"</?[a-zA-Z][^<>]*>", " ", body)
        body = re.sub(r"^\s*\\[(\[](.*)\\[)\]]\s*$", r"\1", body, flags=re.S)
        body = " ".join(body.split())
        return hold(f"$${body}$$" if block else f"${body}$")

    def language(attr: str, body: str) -> str:
        lang = TAG_LANGUAGE.search(attr) or TAG_LANGUAGE.search((re.match(r"\s*<code\b([^>]*)>", body) or ["", ""])[1])
        return "" if not lang or lang[1].lower() in ("src", "code") else lang[1].lower()

    def opaque(source: str) -> str:
        """Code and formulas taken out in one pass; a closer that was once not found is not looked for again."""
        parts: list[str] = []
        missing: set[str] = set()
        at = pos = 0

        def closer(key: str, rx: str, start: int) -> re.Match | None:
            if key in missing:
                return None
            m = re.compile(rx, re.M | re.I).search(source, start)
            if m is None:
                missing.add(key)
            return m

        while m := OPENER.search(source, pos):
            end, new = -1, ""
            if m["fence"]:
                mark = m["fence"]
                if mark[0] == "~" or "`" not in m["info"]:
                    c = re.compile(rf"^ {{0,3}}{re.escape(mark)}[`~]*[ \t]*$", re.M).search(source, m.end())
                    new = code(source[m.end() : c.start() if c else len(source)], _language(m["info"]))
                    end = c.end() if c else len(source)
            elif m["env"]:
                c = closer("end" + m["env"], rf"\\end\{{{re.escape(m['env'])}\}}", m.end())
                if c:
                    body, end = source[m.end() : c.start()], c.end()
                    if MATH_ENV.match(m["env"]):
                        new = formula(body, True)
                    else:
                        lang = LISTING_LANGUAGE.search(m["opt"])
                        new = code(body, lang[1].lower() if lang else m["opt"].strip("{}").lower() if m["env"] == "minted" else "")
            elif m["tag"]:
                name = m["tag"].lower()
                c = closer(name, rf"</{name}\s*>", m.end())
                if c:
                    body = source[m.end() : c.start()]
                    if name == "math":
                        new, end = formula(html.unescape(body), False), c.end()
                    elif name != "code" or "\n" in body and "<" not in body:
                        lang = language(m["attr"], body)
                        new, end = code(html.unescape(re.sub(r"^\s*<code\b[^>]*>|</code\s*>\s*$", "", body)), lang), c.end()
            elif m["span"]:
                c = closer("span", r"</span\s*>", m.end()) if MATH_CLASS.search(m["sattr"]) else None
                if c:
                    new, end = formula(source[m.end() : c.start()], False), c.end()
            elif m["dd"]:
                c = closer("$$", r"\$\$", m.end())
                if c and source[m.end() : c.start()].strip() and "$" not in source[m.end() : c.start()]:
                    new, end = "\n" + formula(source[m.end() : c.start()], True) + "\n", c.end()
            elif m["br"] or m["pa"]:
                shut = r"\\\]" if m["br"] else r"\\\)"
                c = closer(shut, shut, m.end())
                if c and c.start() > m.end():
                    body = formula(source[m.end() : c.start()], bool(m["br"]))
                    new, end = f"\n{body}\n" if m["br"] else body, c.end()
            elif m["ibody"] is not None:
                if MATHY.search(m["ibody"].strip()):
                    new, end = formula(m["ibody"], False), m.end()
            else:
                c = re.compile(rf"(?<!`){m['tick']}(?!`)").search(source, m.end(), (source.find("\n", m.end()) + 1 or len(source) + 1) - 1)
                if c and c.start() > m.end():
                    out.add("other")
                    new, end = hold(source[m.end() : c.start()].strip()), c.end()
            if end < 0:
                pos = m.end() if m.end() > m.start() else m.start() + 1
                continue
            parts += [source[at : m.start()], new]
            at = pos = end
        return "".join([*parts, source[at:]])

    held = plain
    if re.search(r"[`$\\<]|~~~", plain):
        held = opaque(plain)

    # indented code: lines of four spaces after a blank line, outside a list
    if re.search(r"^(?: {4}|\t)", held, re.M):
        lines, res, i = held.split("\n"), [], 0
        while i < len(lines):
            if re.match(r"(?: {4}|\t)\s*\S", lines[i]) and (not res or not res[-1].strip()):
                j = i
                while j < len(lines) and (re.match(r"(?: {4}|\t)", lines[j]) or (not lines[j].strip() and j + 1 < len(lines) and re.match(r"(?: {4}|\t)\s*\S", lines[j + 1]))):
                    j += 1
                before = next((x for x in reversed(res) if x.strip()), "")
                block = lines[i:j]
                codelike = re.search(r"[;{}()=$]|^\s*(?:SELECT|FROM|def|class|for|if|import|let|var)\b", "\n".join(block), re.M)
                if not ((BULLET.match(before) or HASHES.match(before)) and not codelike) and not BULLET.match(block[0].strip() if not codelike else ""):
                    res.append(code("\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in block), ""))
                    i = j
                    continue
                res.extend(block)
                i = j
                continue
            res.append(lines[i])
            i += 1
        held = "\n".join(res)

    if "<" in held or COMMANDS.search(held):
        source_lines = held.split("\n")
        events = _Events(out, len(source_lines))
        events.feed(event_source(held))
        events.close()
        flags = content_lines(events.chars, events.tags)
        drop = [
            not ok and events.tags[i] > 0 and not events.keep[i] and not STRUCTURAL.search(source_lines[i]) for i, ok in enumerate(flags)
        ]
        out.content_share = 1 - sum(drop) / len(drop)
        if any(d and COMMANDS.search(x) for d, x in zip(drop, source_lines, strict=True)):
            out.add("other")
        held = "".join(text for at, text, mark in events.parts if mark or not drop[at])
        held = held.replace(LESS, "<").replace(AMPERSAND, "&")
        held = re.sub("(#{1,6}|-)\ue002\\s*", "\\1\ue002", held)
    if "&" in held:
        def entity(m: re.Match) -> str:
            s = html.unescape(m[0])
            if s == m[0]:
                return s
            out.add("other")
            return s
        held = ENTITY.sub(entity, held)
        held = ENTITY.sub(entity, held)

    latex = "\\documentclass" in held or "\\begin{document}" in held or "\\section" in held or "\\usepackage" in held
    lines = held.split("\n")
    done: list[str] = []
    n = len(lines)
    i = 0
    wiki_table = False
    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            done.append("")
            i += 1
            continue
        if "\ue002" in line:
            mark, _, rest = line.partition("\ue002")
            mark, body = mark.strip(), rest.replace("\ue003", "")
            done.append(f"{mark} {body.strip()}")
            i += 1
            continue
        line = line.replace("\ue003", "")
        m = HASHES.match(line)
        if m:
            j = i
            while j < n and HASHES.match(lines[j]):
                j += 1
            if j - i >= 2:
                for x in lines[i:j]:
                    out.add("list")
                    h = HASHES.match(x)
                    done.append("  " * (len(h[1]) - 1) + "- " + h[2])
                i = j
                continue
        m = ATX.match(s) if line.lstrip(" ").startswith("#") and len(line) - len(line.lstrip(" ")) < 4 else None
        if m:
            out.add("heading", str(len(m[1])))
            title = s[m.end() :].rstrip("#").rstrip() if re.search(r"[ \t]#+$", s) else s[m.end() :]
            done.append(f"{m[1]} {title}")
            i += 1
            continue
        m = WIKI_HEAD.match(s) if s[0] == "=" == s[-1] else None
        if m and not UNDERLINE.match(line):
            out.add("heading", str(len(m[1])))
            done.append(f"{'#' * len(m[1])} {s.strip('=').strip()}")
            i += 1
            continue
        m = UNDERLINE.match(line)
        if m and done and done[-1].strip() and len(m[1]) >= 2 and i and lines[i - 1].strip() and not re.match(r"^\s*(?:[-*+>|#]|\d{1,3}[.)])\s", done[-1]) and not TOKEN.fullmatch(done[-1].strip()):
            level = "#" if m[1][0] == "=" else "##"
            out.add("heading", str(len(level)))
            done[-1] = f"{level} {done[-1].strip()}"
            i += 1
            continue
        if RULE.match(line):
            out.add("other")
            done.append("")
            i += 1
            continue
        if s.startswith("{|"):
            wiki_table = True
        if wiki_table or (s.startswith(("|-", "|}", "{|"))):
            out.add("other")
            if s.startswith("|}"):
                wiki_table = False
            m = WIKI_TABLE.match(line)
            body = "" if m and m[1] in ("{|", "|}", "|-") else s.lstrip("|!+ ")
            if body:
                done.append(" ".join(x.strip() for x in re.split(r"\|\||!!", body)))
            i += 1
            continue
        if TABLE_RULE.match(line):
            out.add("other")
            i += 1
            continue
        if s.startswith("|") and s.endswith("|") and s.count("|") > 2:
            out.add("other")
            done.append(" ".join(x.strip() for x in s.strip("|").split("|")))
            i += 1
            continue
        m = QUOTE.match(line)
        if m:
            out.add("other")
            line = m[1]
            s = line.strip()
        m = REFERENCE.match(line)
        if m:
            out.add("other")
            if m[1].startswith("^"):
                done.append(m[2])
            i += 1
            continue
        if latex and COMMENT_LINE.match(line):
            out.add("other")
            i += 1
            continue
        if "\\" in line:
            if LIST_ENV.search(line):
                out.add("list")
                line = LIST_ENV.sub("", line)
                if not line.strip():
                    i += 1
                    continue
            m = ITEM.match(line)
            if m:
                out.add("list")
                done.append(f"- {m[2]}")
                i += 1
                continue
            m = SECTION.search(line)
            if m:
                out.add("heading", str(SECTIONS[m[1]]))
                line = SECTION.sub(lambda m: f"{'#' * SECTIONS[m[1]]} {m[2]}", line)
                done.append(line.strip())
                i += 1
                continue
        m = BULLET.match(line)
        if m:
            out.add("list")
            depth = (len(m[2]) - 1) if m[2].startswith("*") else len(m[1].expandtabs(4)) // 2
            done.append("  " * depth + ("- " if not m[2][0].isdigit() else f"{m[2]} ") + m[3])
            i += 1
            continue
        done.append(line)
        i += 1
    held = "\n".join(done)
    if INLINE_HINT.search(held):
        for rx, to in INLINE:
            held, k = rx.subn(to, held)
            if k:
                out.add("other")
    for _ in range(3):
        if not TOKEN.search(held):
            break
        held = TOKEN.sub(lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", held)
    held = re.sub("[\ue000-\ue003]", "", held)
    if not out.kinds:
        return Converted(text)
    held = re.sub(r"[ \t]+\n", "\n", held)
    out.text = re.sub(r"\n{3,}", "\n\n", held).strip("\n")
    return out
