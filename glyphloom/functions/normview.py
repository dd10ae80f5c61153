"""The normalised view of a document: reading text and, run by run, the source ranges it came from."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice
from operator import le

import numpy as np
import regex

from glyphloom.functions.chars import ALNUM_RUN, DECOR_TAIL, INVISIBLE, IS_DECOR, LOOKALIKES, PUNCT, entity, numeric_ref
from glyphloom.functions.document import FULL_FOLD, QUOTED, Doc

_SPOT = regex.compile(
    rf"(?V1)(?P<reference>&)|\\(?P<escape>(?<=\\)[{regex.escape(''.join(sorted(PUNCT)))}])|(?P<invisible>{INVISIBLE.pattern})|(?P<run>[[^\x00-\x7f]--{INVISIBLE.pattern}]+)"
)
_SPECIAL = regex.compile(rf"[&\\{INVISIBLE.pattern[1:]}")


def _composing() -> str:
    """Characters that may join the one before them in canonical composition: second parts of composed letters, Hangul vowels and finals."""
    out = {chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for o in (*range(0xC0, 0x3000), *range(0x3040, 0x3100), *range(0xFB00, 0xFB50), *range(0x11000, 0x11A00), *range(0x1D100, 0x1D200)):
        parts = unicodedata.decomposition(chr(o)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return "".join(sorted(out))


#: A run that holds one of these is normalised as a whole, even if that changes nothing: its characters cannot be told apart by their source.
_JOINING = regex.compile(f"[{_composing()}]")
_ALIKE = regex.compile("[" + "".join(LOOKALIKES) + "]")


@dataclass
class NormView:
    """Text in runs: run ``i`` begins at ``starts[i]`` of the view and came from source [src[i], end[i]).

    A straight run maps character by character; the characters of any other run all came from the whole of its range.
    """

    text: str = ""
    starts: list[int] = field(default_factory=list)
    src: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    straight: list[bool] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)
    #: union of all flags: a flag that no run has needs no look at the runs
    bits: int = 0
    _sorted: bool | None = None

    @classmethod
    def plain(cls, text: str, blocks: list[int]) -> "NormView":
        """A view that is its own source."""
        return cls(text, [0], [0], [len(text)], [0], [True], blocks, blocks)

    def _run(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def source(self, a: int, b: int) -> tuple[int, int] | None:
        if a >= b or b > len(self.text):
            return None
        i, j = self._run(a), self._run(b - 1)
        s = self.src[i] + a - self.starts[i] if self.straight[i] else self.src[i]
        e = self.src[j] + b - self.starts[j] if self.straight[j] else self.end[j]
        return (s, e) if e >= s else None

    def at_source(self, at: int) -> int | None:
        """First character of the view that came from source offset ``at``."""
        if self._sorted is None:
            reach = [s + 1 if straight else e for s, e, straight in zip(self.src, self.end, self.straight)]
            self._sorted = all(map(le, self.end, islice(reach, 1, None)))
        for i in range(bisect_right(self.end, at) if self._sorted else 0, len(self.src)):
            if self.src[i] <= at < self.end[i]:
                return self.starts[i] + (at - self.src[i] if self.straight[i] else 0)
            if self._sorted and self.src[i] > at:
                return None
        return None

    def from_source(self, start: int, end: int) -> str:
        """Text of the view that came from a source range."""
        out = []
        for i, (n, s, e) in enumerate(zip(self.starts, self.src, self.end)):
            if s < end and e > start:
                stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
                out.append(self.text[n + max(0, start - s) : n + min(e, end) - s] if self.straight[i] else self.text[n:stop])
        return "".join(out)

    def _flags(self, a: int, b: int) -> list[int]:
        return self.flags[self._run(a) : self._run(b - 1) + 1] if a < b else []

    def has(self, at: int, bit: int) -> bool:
        return bool(self.bits & bit) and bool(self.flags[self._run(at)] & bit)

    def all_quoted(self, a: int, b: int) -> bool:
        return a >= b or bool(self.bits & QUOTED) and all(f & QUOTED for f in self._flags(a, b))

    def any_flag(self, a: int, b: int, bit: int) -> bool:
        return bool(self.bits & bit) and any(f & bit for f in self._flags(a, b))

    def quoted_before(self) -> np.ndarray | None:
        """Number of quoted characters before every place of the view; None where nothing is quoted."""
        if not self.bits & QUOTED:
            return None
        sizes = np.diff([*self.starts, len(self.text)])
        return np.concatenate([[0], np.cumsum(np.repeat(np.array(self.flags, dtype=np.int64) & QUOTED, sizes))])

    def opens(self, at: int) -> bool:
        """Whether a block, line or sentence opens at ``at``; leading decoration is looked past."""
        if at == 0:
            return True
        low = max(0, at - 400)
        head = self.text[low:at]
        k = DECOR_TAIL.search(head).start()
        if low and k == 0:
            k = DECOR_TAIL.search(self.text[:at]).start() - low
        before = head[:k] if k >= 0 else self.text[: low + k]
        if not before and low + k <= 0:
            return True
        gap = self.text[low + k : at]
        if "\n" in gap:
            # decoration includes line breaks: a break inside it opens a line
            return True
        if before[-1:] in (".", "!", "?", ":") and gap:
            return True
        i = bisect_right(self.lines, at) - 1
        return i >= 0 and IS_DECOR.fullmatch(self.text, self.lines[i], at) is not None


class _Builder:
    def __init__(self, src: str):
        self.src = src
        self.parts: list[str] = []
        self.size = 0
        self.view = NormView()

    def _add(self, a: int, b: int, to: str, flags: int, straight: bool) -> None:
        v = self.view
        if straight and v.src and v.straight[-1] and v.end[-1] == a and v.flags[-1] == flags:
            v.end[-1] = b
        else:
            v.starts.append(self.size)
            v.src.append(a)
            v.end.append(b)
            v.flags.append(flags)
            v.straight.append(straight)
            v.bits |= flags
        self.parts.append(to)
        self.size += len(to)

    def same(self, a: int, b: int, flags: int) -> None:
        if a < b:
            self._add(a, b, self.src[a:b], flags, True)

    def mapped(self, a: int, b: int, to: str, flags: int) -> None:
        if to:
            self._add(a, b, to, flags, False)

    def closes_line(self) -> bool:
        return not self.parts or self.parts[-1].endswith("\n")

    def text(self, a: int, b: int, flags: int) -> None:
        """Source text: what one of the readers of ``_SPOT`` gives another form for is mapped, the rest goes through as it stands."""
        s = self.src[a:b]
        if not _SPECIAL.search(s) and (s.isascii() or unicodedata.is_normalized("NFC", s) and not _JOINING.search(s)):
            self.same(a, b, flags)
            return
        at = done = 0
        while m := _SPOT.search(s, at):
            at, form = _READERS[m.lastgroup](s, m)
            if form is None:
                continue
            if m.lastgroup == "invisible":
                self.view.removed.append(a + m.start())
            self.same(a + done, a + m.start(), flags)
            self.mapped(a + m.start(), a + at, form, flags)
            done = at
        self.same(a + done, b, flags)


def _reference(s: str, m: regex.Match) -> tuple[int, str | None]:
    """A character reference: the listed entities, and numbers that name a visible character; hidden or overlong ones leave a barrier."""
    at = m.start()
    if known := entity(s, at):
        return at + known[0], known[1]
    verdict, size, c = numeric_ref(s, at)
    if verdict == "literal":
        return at + 1, None
    return at + size, unicodedata.normalize("NFC", c) if verdict == "decode" else "\ufffd"


def _composed(s: str, m: regex.Match) -> tuple[int, str | None]:
    """A run beyond ASCII in canonical composition, or None where that is what stands there."""
    plain = unicodedata.is_normalized("NFC", m[0]) and not _JOINING.search(m[0])
    return m.end(), None if plain else unicodedata.normalize("NFC", m[0])


_READERS = {
    "reference": _reference, "escape": lambda s, m: (m.end(), m[0][1]), "invisible": lambda s, m: (m.end(), ""), "run": _composed,
}


@lru_cache(maxsize=1 << 16)
def _folds(token: str) -> tuple[list[str | None], bool] | None:
    """Replacement of each character of one word, and whether the word folds only because all of it can."""
    if unicodedata.is_normalized("NFKC", token) and not _ALIKE.search(token):
        return None
    compat: list[str | None] = []
    for c in token:
        f = None
        if c >= "\x80" and c.isalpha():
            k = unicodedata.normalize("NFKC", c)
            f = k if k != c else None
        compat.append(f)
    latin = any((f is not None and f and f.isascii() and f.isalpha()) or (f is None and c.isascii() and c.isalpha()) for c, f in zip(token, compat))
    whole = not latin and not token.isascii() and all(c.isascii() or (f is not None and f.isascii()) or c in LOOKALIKES for c, f in zip(token, compat))
    out = [f if f is not None else (LOOKALIKES.get(c) if latin or whole else None) for c, f in zip(token, compat)]
    return (out, whole) if any(x is not None for x in out) else None


def build(doc: Doc, fold: bool = True) -> NormView:
    """The view of a document; without ``fold`` look-alike and compatibility letters stay as they are."""
    b = _Builder(doc.text)
    v = b.view
    for op in doc.ops:
        kind = op[0]
        if kind == "block":
            if not b.closes_line():
                at = v.end[-1]
                b.mapped(at, at, "\n", 0)
            v.lines.append(b.size)
            v.blocks.append(b.size)
        elif kind == "text":
            b.text(op[1], op[2], op[3])
        elif kind == "own":
            b.mapped(op[1], op[2], op[3], op[4])
        elif kind == "break":
            b.mapped(op[1], op[2], "\n" if op[3] else " ", op[4])
            if op[3]:
                v.lines.append(b.size)
        else:
            b.mapped(op[1], op[2], "\ufffd", op[3])
    v.text = "".join(b.parts)
    if fold and not v.text.isascii():
        _fold(v)
    return v


def _fold(v: NormView) -> None:
    """Folds look-alike and compatibility letters, word by word."""
    if not _ALIKE.search(v.text) and unicodedata.is_normalized("NFKC", v.text):
        return
    edits: list[tuple[int, str, bool]] = []
    for m in ALNUM_RUN.finditer(v.text):
        if not m[0].isascii() and (f := _folds(m[0])):
            edits += [(m.start() + k, to, f[1]) for k, to in enumerate(f[0]) if to is not None]
    if not edits:
        return
    pieces: list[str] = []
    at = 0
    for k, to, _ in edits:
        pieces += (v.text[at:k], to)
        at = k + 1
    pieces.append(v.text[at:])
    if any(whole or len(to) != 1 for _, to, whole in edits):
        _refit(v, edits)
    v.text = "".join(pieces)


def _refit(v: NormView, edits: list[tuple[int, str, bool]]) -> None:
    """Runs, blocks and lines after edits that change sizes or flags (character, its replacement, whether its word folds as a whole)."""
    old = NormView(v.text, v.starts, v.src, v.end, v.flags, v.straight)
    b = _Builder("")
    new = b.view
    i = 0

    def take(a: int, stop: int, to: str | None, extra: int) -> None:
        """Characters [a, stop) of the old view, or their replacement, as runs of the new one."""
        nonlocal i
        while a < stop:
            while i + 1 < len(old.starts) and old.starts[i + 1] <= a:
                i += 1
            e = min(stop, old.starts[i + 1] if i + 1 < len(old.starts) else len(old.text))
            here = old.src[i] + a - old.starts[i]
            text = old.text[a:e] if to is None else to
            if old.straight[i]:
                b._add(here, here + e - a, text, old.flags[i] | extra, len(text) == e - a)
            else:
                b._add(old.src[i], old.end[i], text, old.flags[i] | extra, False)
            a = e

    at = grown = 0
    moved: list[tuple[int, int]] = []
    for k, to, whole in edits:
        take(at, k, None, 0)
        take(k, k + 1, to, FULL_FOLD if whole else 0)
        at = k + 1
        if len(to) != 1:
            grown += len(to) - 1
            moved.append((k, grown))
    take(at, len(old.text), None, 0)

    def shift(starts: list[int]) -> list[int]:
        out, j, add = [], 0, 0
        for s in starts:
            while j < len(moved) and moved[j][0] < s:
                add = moved[j][1]
                j += 1
            out.append(s + add)
        return out

    v.starts, v.src, v.end, v.flags, v.straight, v.bits = new.starts, new.src, new.end, new.flags, new.straight, new.bits
    v.blocks, v.lines = shift(v.blocks), shift(v.lines)
