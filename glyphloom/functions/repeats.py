"""Repeated word runs of a view (U001), over integer arrays.

Words become dense ids and barrier-free stretches become fences, so that the agreement of two places is
one comparison of array slices.  Windows of ``k`` words are grouped by an id of their own; a document in which every
window is unique has no repeat and is left at once.
"""

from __future__ import annotations

import numpy as np
import regex

from glyphloom.functions.normview import NormView
from glyphloom.functions.shapes import Span

_WORD = regex.compile(r"[\p{Alphabetic}\p{N}'’]+")
BARRIER = "\ufffd"
#: Words up to which a set of tuples is asked first.
SMALL = 4_000
#: Fixed value: earlier places of one window that are compared, the nearest first.
NEAREST = 32


def window_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """A number below the count of windows for every window of ``k`` ids, equal exactly where the windows are."""
    out, size = ids, 1
    while size < k:
        # ranks of overlapping pairs of the windows so far
        step = min(size, k - size)
        base = int(out.max(initial=0)) + 1
        out = np.unique(out[: len(out) - step] * base + out[step:], return_inverse=True)[1]
        size += step
    return out


def agreement(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common head of two arrays of one length."""
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else len(x)


class Repeats:
    """Maximal runs of at least ``floor`` words that stand earlier in the same view, the two copies apart."""

    def __init__(self, norm: NormView, k: int, floor: int):
        self.k, self.floor, self.norm = k, floor, norm
        seen: dict[str, int] = {}
        text = norm.text.replace("’", "'")
        words = _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]
        if len(words) <= SMALL and len(set(zip(*(words[d:] for d in range(k))))) == max(0, len(words) - k + 1):
            words = []  # most short texts repeat nothing, which a set of their windows tells sooner than arrays
        self.ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        self.windows = window_ids(self.ids, k) if len(words) > k else self.ids[:0]

    def fences(self) -> None:
        """For every word the barrier-free stretch [fence, wall) that holds it."""
        self.spans = [m.span() for m in _WORD.finditer(self.norm.text)]
        at = np.array([a for a, _ in self.spans], dtype=np.int64)
        bars = np.array([m.start() for m in regex.finditer(BARRIER, self.norm.text)], dtype=np.int64)
        stretch = np.searchsorted(bars, at)
        self.fence = np.searchsorted(stretch, stretch, "left")
        self.wall = np.searchsorted(stretch, stretch, "right")

    def open_windows(self) -> np.ndarray:
        """Whether a window may anchor a repeat: inside one stretch, nothing of it quoted."""
        n = len(self.windows)
        ok = self.wall[:n] >= np.arange(n) + self.k
        if (quoted := self.norm.quoted_before()) is not None:
            ok &= quoted[[b for _, b in self.spans[self.k - 1 :]]] == quoted[[a for a, _ in self.spans[:n]]]
        return ok

    def stretch(self, early: int, late: int) -> tuple[int, int, int]:
        """The longest common run around two equal windows that keeps its copies apart: (start, start, words)."""
        room = min(self.wall[early] - early, self.wall[late] - late, late - early)
        after = agreement(self.ids[early : early + room], self.ids[late : late + room])
        room = min(early - self.fence[early], late - self.fence[late], late - early - after)
        before = agreement(self.ids[early - room : early][::-1], self.ids[late - room : late][::-1])
        return early - before, late - before, before + after

    def runs(self) -> list[tuple[int, int, int]]:
        """Runs from left to right, each window measured against the nearest earlier ones; a run found is passed over."""
        often = np.bincount(self.windows)
        if len(often) == len(self.windows):
            return []
        self.fences()
        todo = np.flatnonzero(self.open_windows() & (often[self.windows] > 1))
        places: dict[int, list[int]] = {}
        out: list[tuple[int, int, int]] = []
        free = 0
        for late in map(int, todo):
            if late < free:
                continue
            known = places.setdefault(int(self.windows[late]), [])
            apart = [self.stretch(e, late) for e in reversed(known[-NEAREST:]) if late - e >= self.k]
            known.append(late)
            widest = max(apart, key=lambda x: x[2], default=(0, 0, 0))
            if widest[2] >= self.floor:
                out.append(widest)
                free = widest[1] + widest[2]
        return out

    def longest(self, most: int) -> list[tuple[Span, Span]]:
        """(later copy, earlier copy) as spans of the view, the ``most`` longest, ties by place."""
        best = sorted(self.runs(), key=lambda x: (-x[2], x[1], x[0]))[:most]
        area = lambda at, size: (self.spans[at][0], self.spans[at + size - 1][1])
        return [(area(y, size), area(x, size)) for x, y, size in best]
