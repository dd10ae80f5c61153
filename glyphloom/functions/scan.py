"""Word-set and pattern scans over the views of a document, with their per-rule filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from re import _parser as sre

import regex

from glyphloom import policy
from glyphloom.functions.chars import cont, lower_ascii
from glyphloom.functions.document import FULL_FOLD, Doc
from glyphloom.functions.normview import NormView
from glyphloom.functions.shapes import period_ends

# Word classes of the concession and participle filters.
BE = frozenset("am is are was were be being".split())
GAP_ADVERBS = frozenset("still already yet now just also again always currently never".split())
FINITE = frozenset("am is are was were has have had do does did can could will would shall should may might must".split())
CONCEDING = frozenset("acknowledging recognizing granting accepting conceding admitting noting allowing".split())
NOT_PARTICIPLES = frozenset("nothing anything something everything during".split())
DETERMINERS = frozenset("the a an its our their his her my your this that these those".split())
TEXT_INFOS = frozenset("text txt plain plaintext md markdown prose".split())
ZERO_WIDTH = set("\u200b\u200c\u200d\u2060\ufeff")
CJK = regex.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")


@dataclass
class Hit:
    rule: str
    start: int
    end: int
    quoted: bool = False
    force_candidate: bool = False
    force_hint: bool = False
    trigger: str | None = None
    detail: str | None = None


def in_context(r: policy.Rule, context: str) -> bool:
    if context == "norm":
        return r.view == "norm" and r.scope == "none"
    if context == "raw":
        return r.view == "raw" and r.scope == "none"
    if context == "prose":
        return r.view == "prose" and r.scope == "none"
    if context == "link":
        return r.scope == "link-url" or r.id == "P002"
    return r.scope == context


class Engine:
    """Automata and patterns of one profile: rules that are off are left out before anything is scanned."""

    def __init__(self, profile: str | None):
        """``profile`` null leaves every rule on."""
        import ahocorasick

        self.profile = profile
        self.rules = policy.rules()
        self.on = {i for i, r in self.rules.items() if profile is None or r.stance(profile) != "off"}
        self.words: dict[tuple[str, bool], object] = {}
        self.patterns: dict[str, list[tuple[str, object, tuple[frozenset[str], ...]]]] = {}
        for context in ("norm", "raw", "prose", "link", "code"):
            for sensitive in (False, True):
                table: dict[str, list[str]] = {}
                for r in self.rules.values():
                    if r.id not in self.on or r.kind != "word-set" or r.case_sensitive != sensitive:
                        continue
                    # case-sensitive words are read from prose and link regions whatever their view
                    if sensitive and context in ("prose", "link") and (r.view == "prose" or r.scope == "link-url") or not sensitive and in_context(r, context):
                        for t in r.terms:
                            table.setdefault(t if sensitive else lower_ascii(t), []).append(r.id)
                if table:
                    a = ahocorasick.Automaton()
                    for w, ids in table.items():
                        a.add_word(w, (len(w), tuple(ids)))
                    a.make_automaton()
                    self.words[context, sensitive] = a
            self.patterns[context] = [
                (r.id, compiled(p), needles(p)) for r in self.rules.values() if r.id in self.on and in_context(r, context) for p in r.patterns
            ]
        # one automaton a context over the literals that patterns ask for, in lower case; it only says which patterns to try
        self.needles: dict[str, object] = {}
        for context, ps in self.patterns.items():
            literals = sorted({w.lower() for _, _, need in ps for o in need for w in o})
            auto = self.needles[context] = ahocorasick.Automaton()
            for w in literals:
                auto.add_word(w, w)
            if literals:
                auto.make_automaton()
            self.patterns[context] = [(rid, rx, tuple(frozenset(w.lower() for w in o) for o in need)) for rid, rx, need in ps]

    def scan(self, doc: Doc, norm: NormView) -> list[Hit]:
        src, hits = doc.text, []
        self._words(norm.text, "norm", norm, 0, hits)
        self._words(src, "raw", None, 0, hits)
        for s, e in doc.links:
            self._words(src[s:e], "link", None, s, hits)
        if self._holds(src, "prose"):
            for s, e, _ in doc.prose:
                self._words(src[s:e], "prose", None, s, hits, sensitive=True)
        for s, e in doc.links:
            self._words(src[s:e], "link", None, s, hits, sensitive=True)
        self._patterns(norm.text, [(0, len(norm.text))], "norm", norm, hits)
        self._patterns(src, [(0, len(src))], "raw", None, hits)
        self._patterns(src, [(s, e) for s, e, _ in doc.prose], "prose", None, hits)
        self._patterns(src, doc.links, "link", None, hits)
        for s, e, text in doc.decoded:
            self._decoded(src, s, e, text, hits)
        self._patterns(src, [(s, e) for s, e, fenced, info in doc.code if not (fenced and (info.split() or [""])[0] in TEXT_INFOS)], "code", None, hits)
        return widest(hits)

    def scan_view(self, norm: NormView, hits: list[Hit]) -> None:
        """The scans of the norm view alone."""
        self._words(norm.text, "norm", norm, 0, hits)
        self._patterns(norm.text, [(0, len(norm.text))], "norm", norm, hits)

    def _holds(self, text: str, context: str) -> bool:
        """Whether any case-sensitive word of a context stands anywhere in a text."""
        auto = self.words.get((context, True))
        return auto is not None and next(auto.iter(text), None) is not None

    def _decoded(self, src: str, s: int, e: int, text: str, hits: list[Hit]) -> None:
        if s >= e or not text:
            return
        found: list[Hit] = []
        self._words(text, "link", None, 0, found)
        self._words(text, "link", None, 0, found, sensitive=True)
        self._patterns(text, [(0, len(text))], "link", None, found)
        for h in found:
            t = text[h.start : h.end]
            at = src.find(t, s, e)
            hits.append(Hit(h.rule, *((at, at + len(t)) if at >= 0 else (s, e)), trigger=t))

    def _words(self, hay: str, context: str, norm: NormView | None, base: int, hits: list[Hit], sensitive: bool = False) -> None:
        auto = self.words.get((context, sensitive))
        if auto is None or not hay:
            return
        low = hay if sensitive else lower_ascii(hay)
        for last, (size, ids) in auto.iter(low):
            a, b = last - size + 1, last + 1
            for rid in ids:
                r = self.rules[rid]
                if r.word_boundary and (cont(hay[a - 1 : a]) or cont(hay[b : b + 1])):
                    continue
                if norm is not None:
                    anchored = r.block_start or rid == "T001" and low[a:b] == "overall" or hay[a:b].lower() in r.params.get("block_start_only", ())
                    if anchored and not norm.opens(a):
                        continue
                if r.exempt and exempted(hay, a, b, r.exempt):
                    continue
                if rid == "A002" and participle_adjective(hay, a, b):
                    continue
                self._add(rid, hay, a, b, norm, base, hits)

    @staticmethod
    def _add(rid: str, hay: str, a: int, b: int, norm: NormView | None, base: int, hits: list[Hit]) -> None:
        if norm is None:
            if a < b:
                hits.append(Hit(rid, base + a, base + b, trigger=hay[a:b]))
            return
        span = norm.source(a, b)
        if span and span[0] < span[1]:
            hits.append(Hit(rid, *span, norm.all_quoted(a, b), norm.any_flag(a, b, FULL_FOLD), trigger=hay[a:b]))

    def _patterns(self, hay: str, pieces: list[tuple[int, int]], context: str, norm: NormView | None, hits: list[Hit]) -> None:
        """Every pattern of a context over the pieces of a text; patterns whose literals the text lacks are not tried."""
        table = self.patterns[context]
        if not pieces or not table:
            return
        auto = self.needles[context]
        there = {w for _, w in auto.iter(hay.lower())} if len(auto) else set()
        live = [(rid, rx) for rid, rx, need in table if not any(map(there.isdisjoint, need))]
        if not live:
            return
        for start, end in pieces:
            if start >= end:
                continue
            for rid, rx in live:
                for m in rx.finditer(hay, start, end, overlapped=True):
                    a, b = m.span()
                    kept = keep(rid, hay, a, b) if a < b else None
                    if kept is None:
                        continue
                    if norm is None:
                        hits.append(Hit(rid, kept, b, trigger=hay[kept:b]))
                    elif (span := norm.source(kept, b)) and span[0] < span[1]:
                        hits.append(Hit(rid, *span, norm.all_quoted(kept, b), trigger=hay[kept:b]))


@lru_cache(maxsize=None)
def compiled(pattern: str):
    p = regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)
    return regex.compile(p, regex.M | regex.U)


#: Alternatives of one needed literal beyond which a pattern is simply tried.
MAX_NEEDLES = 40


#: Alternatives of one needed literal beyond which it is not asked for.
MAX_NEEDLES = 40


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of literals of each of which every match holds at least one, the most telling first (lower case where the pattern folds case)."""
    p = regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)
    options = _needed(list(sre.parse(regex.sub(r"\\p\{[^}]*\}", r"\\w", p))))
    if folds_case(pattern):
        options = [frozenset(x.lower() for x in o) for o in options]
    return tuple(dict.fromkeys(sorted(options, key=_telling, reverse=True)))[:3]


def folds_case(pattern: str) -> bool:
    return bool(regex.match(r"\(\?[a-z]*i[a-z]*\)", pattern))


def _telling(option: frozenset[str]) -> tuple[int, int]:
    return min(map(len, option)), -len(option)


def _needed(nodes: list) -> list[frozenset[str]]:
    """What the parts of a sequence need, each as a set of alternatives."""
    options: list[frozenset[str]] = []
    run: list[str] = []
    for op, arg in [*nodes, ("END", None)]:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(arg))
            continue
        if name == "AT":
            continue
        if run:
            options.append(frozenset(["".join(run)]))
            run.clear()
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            options.append(frozenset(chr(x) for _, x in arg))
        elif name == "SUBPATTERN":
            options += _needed(list(arg[3]))
        elif name == "BRANCH":
            arms = [max(_needed(list(x)), key=_telling, default=frozenset()) for x in arg[1]]
            options += [frozenset().union(*arms)] if all(arms) else []
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            options += _needed(list(arg[2]))
    return [o for o in options if len(o) <= MAX_NEEDLES]


def exempted(hay: str, a: int, b: int, phrases: tuple[str, ...], reach: int = 60) -> bool:
    """Whether an exempt phrase near the match covers it."""
    low = max(0, a - reach)
    window = hay[low : b + reach].lower()
    for p in phrases:
        at = window.find(p)
        while at >= 0:
            if low + at <= a and low + at + len(p) >= b:
                return True
            at = window.find(p, at + 1)
    return False


def participle_adjective(hay: str, a: int, b: int) -> bool:
    """An ``-ed`` form after a hyphen, a determiner or possessive, or an ``-ly`` word is an adjective."""
    if not hay[a:b].lower().endswith("ed"):
        return False
    if hay[a - 1 : a] == "-" and cont(hay[a - 2 : a - 1]):
        return True
    words = regex.findall(r"[\p{Alphabetic}\p{N}']+", hay[max(0, a - 80) : a])
    prev = lower_ascii(words[-1]) if words else ""
    return prev in DETERMINERS or (len(prev) > 3 and prev.endswith("ly"))


def clause_words(clause: str) -> list[str]:
    return [lower_ascii(regex.sub(r"^[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+$", "", w)) for w in clause.split()]


def temporal_while(clause: str) -> bool:
    """A progressive or participial ``while`` clause tells of time and concedes nothing."""
    w = clause_words(clause)
    ing = [len(x) > 3 and x.endswith("ing") for x in w] + [False, False]
    for i, x in enumerate(w):
        if x in BE and (ing[i + 1] or (i + 1 < len(w) and (w[i + 1].endswith("ly") or w[i + 1] in GAP_ADVERBS) and ing[i + 2])):
            return True
    head = participle_head(clause)
    return head is not None and head not in CONCEDING and not any(x in FINITE for x in w)


def participle_head(s: str) -> str | None:
    m = regex.match(r"[\p{Alphabetic}\p{N}'-]+", s)
    word = m[0].lower() if m else ""
    return word if len(word) > 4 and word.endswith("ing") and word not in NOT_PARTICIPLES else None


def keep(rid: str, hay: str, a: int, b: int) -> int | None:
    """Start of the match after the rule's own filter, or None when the filter drops it."""
    if rid == "P003":
        if hay[a] == "【" and CJK.search(hay, a, b):
            return None
        if hay[a] in "†‡" and not hay[hay.rfind("\n", 0, a) + 1 : a].strip():
            return None
    elif rid == "M004":
        if set(hay[a:b]) <= ZERO_WIDTH and not (cont(hay[a - 1 : a]) and cont(hay[b : b + 1])):
            return None
    elif rid == "E002":
        if hay[:a].rstrip()[-6:].endswith(("MUST", "SHOULD", "SHALL", "MAY")):
            return None
    elif rid == "C004":
        head = hay[a:b].lstrip()
        if head[:5].lower() == "while" and temporal_while(head[5:].lstrip().partition(",")[0]):
            return None
        if hay[a] in ".!?":
            line = hay[hay.rfind("\n", 0, a) + 1 : a].lstrip()
            if line and line[-1] in "0123456789" and all(c in "0123456789" for c in line):
                return None
            if hay[a] == "." and not period_ends(hay, a + 1):
                return None
            a += 1
            while a < b and hay[a].isspace():
                a += 1
            if a >= b:
                return None
    return a


def widest(hits: list[Hit]) -> list[Hit]:
    """Per rule, drops a hit inside the hit kept before it; hits come back in rule, start, longest order."""
    order = {r: i for i, r in enumerate(policy.rules())}
    out: list[Hit] = []
    for h in sorted(hits, key=lambda h: (order[h.rule], h.start, -h.end)):
        if out and out[-1].rule == h.rule and h.start >= out[-1].start and h.end <= out[-1].end:
            continue
        out.append(h)
    return out
