"""Evaluation passages inside training text (problem 6).

A broadcast hash set of normalised item n-grams is scanned over the token windows of
every document.  Each hit is verified by aligning the item with every window of the document
around it: at least half of the item's words must occur in order in one passage, a few
words changed or left out.  The n-grams of an item are as long as the run of words that
any such passage keeps (3 words, 2 for items under about 30 words, at most as long as half
the item), so a changed or put-in word never hides one; only words left out of the item
between all of its runs could.

Defined results: a null or empty document leaks nothing; an item without words has no
n-gram and is never reported; repeated items are reported under each ``item_id``.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from dataclasses import dataclass, field

import xxhash

from glyphloom.llm.textforms import fold

SHARE = 0.5
#: least share of matched words among the words of the passage
DENSE = 0.7
_SPLIT = re.compile(r"\s+")
_PUNCT = re.compile(r"[^\w]|_")
_SPACELESS = re.compile("([぀-ヿ㐀-䶿一-鿿฀-๿])")


def leak_words(text: str | None) -> list[str]:
    """Folded, case-folded words without punctuation and accents; spaceless scripts go character by character."""
    if not text:
        return []
    t = fold(text).casefold()
    if not t.isascii():
        t = _SPACELESS.sub(r" \1 ", t)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return [w for w in (_PUNCT.sub("", x) for x in _SPLIT.split(t)) if w]


@dataclass
class ItemIndex:
    ids: list[int]
    words: list[list[str]]
    grams: dict[str, list[tuple[int, int]]]
    #: lengths of the n-grams, from each item's ``run_length``
    lengths: list[int]
    #: places of the words of the items met so far, as bits
    masks: dict[int, dict[str, int]] = field(default_factory=dict)


def run_length(n: int) -> int:
    """Words in a row that every passage of an item of ``n`` words shares with it, if words are changed or put in.

    A passage of m matched words has at most m / DENSE - m others, which cut it into one run more.
    """
    least = max(1, math.ceil(SHARE * n))
    return min(-(-m // (int(m / DENSE + 1e-9) - m + 1)) for m in range(least, n + 1))


def build_index(items: list[tuple[int, str | None]]) -> ItemIndex:
    """Hash set of the items' n-grams; its size is the number of item words, checked by the caller before broadcast."""
    ids, words, grams, lengths = [], [], {}, set()
    for item_id, text in items:
        w = leak_words(text)
        if not w:
            continue
        k = len(ids)
        ids.append(item_id)
        words.append(w)
        n = run_length(len(w))
        lengths.add(n)
        for i in range(len(w) - n + 1):
            grams.setdefault(" ".join(w[i : i + n]), []).append((k, i))
    return ItemIndex(ids, words, grams, sorted(lengths))


def pieces(text: str) -> list[tuple[int, str]]:
    """The text cut at white space: (number of leak words, piece with the white space after it)."""
    out = []
    for m in re.finditer(r"\S+\s*|\s+", text):
        out.append((len(leak_words(m[0])), m[0]))
    return out


def gram_key(words: list[str]) -> int:
    """A 64-bit key of an n-gram, for joins; what meets by chance is turned away by the verifier."""
    k = xxhash.xxh64_intdigest(" ".join(words))
    return k - (1 << 64) if k >> 63 else k


def places(item: list[str]) -> dict[str, int]:
    mask: dict[str, int] = {}
    for i, w in enumerate(item):
        mask[w] = mask.get(w, 0) | 1 << i
    return mask


def passages(item: list[str], doc: list[str], need: float, mask: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(matched words, first and last document word) of every passage, no two overlapping, the fullest first.

    A passage is a window in which at least ``need`` item words stand in order (longest
    common subsequence) and make up ``DENSE`` of its words.  Every window that begins and
    ends with an item word is tried, by bit-parallel rows: starts x window x len(item) / 64.
    """
    mask = places(item) if mask is None else mask
    out = []
    todo = [(0, len(doc))]
    while todo:
        lo, hi = todo.pop()
        best = _windows(mask, len(item), doc, lo, hi, need)
        if not best:
            continue
        taken: list[tuple[int, int]] = []
        for k, a, b in sorted(best, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            at = bisect.bisect(taken, (a, b))
            if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                out.append((k, a, b))
        # what lies between may hold windows that were longer, and overlapped, at first
        todo += zip([lo, *(b for _, b in taken)], [*(a for a, _ in taken), hi], strict=True)
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _windows(mask: dict[str, int], n: int, doc: list[str], lo: int, hi: int, need: float) -> list[tuple[int, int, int]]:
    """The fullest, then shortest, passage from every start in doc[lo:hi]."""
    at = [j for j in range(lo, hi) if doc[j] in mask]
    least = max(1, math.ceil(need))
    if len(at) < least:
        return []
    rows = [mask[doc[j]] for j in at]
    # were all item words in order, the window from the s-th to the e-th would be dense where ends[e] >= e's start
    ends = [e + 1 - DENSE * (j + 1) for e, j in enumerate(at)]
    top = list(itertools.accumulate(reversed(ends), max))[::-1]
    full, longest = (1 << n) - 1, n / DENSE
    out = []
    for s in range(len(at) - least + 1):
        floor = s - DENSE * at[s] - 1e-9
        if top[s + least - 1] < floor:
            continue
        v, best = full, None
        for e in range(s, len(at)):
            if top[e] < floor or at[e] - at[s] >= longest:
                break
            u = v & rows[e]
            v = ((v + u) | (v - u)) & full
            if e - s + 1 < least or ends[e] < floor:
                continue
            k = n - v.bit_count()
            if k >= need and k >= DENSE * (at[e] + 1 - at[s]) - 1e-9 and (best is None or k > best[0]):
                best = (k, at[s], at[e] + 1)
        if best:
            out.append(best)
    return out


def leaks(text: str | None, index: ItemIndex, share: float = SHARE) -> list[tuple[int, int, int, int, int]]:
    """(item_id, matched words, item words, first doc word, last doc word) of every leaked passage of every item."""
    words = leak_words(text)
    if not words:
        return []
    found: dict[int, set[int]] = {}
    grams = index.grams
    for n in index.lengths:
        for j in range(len(words) - n + 1):
            hit = grams.get(" ".join(words[j : j + n]))
            if hit:
                for k, _ in hit:
                    found.setdefault(k, set()).add(j)
    out = []
    for k, hits in found.items():
        item = index.words[k]
        need = share * len(item)
        mask = index.masks.get(k)
        if mask is None:
            mask = index.masks[k] = places(item)
        # a passage has at most len(item) / DENSE words, so none that holds a hit leaves these stretches
        reach = math.ceil(len(item) / DENSE) + 1
        stretches: list[list[int]] = []
        for j in sorted(hits):
            if stretches and j - reach <= stretches[-1][1]:
                stretches[-1][1] = min(len(words), j + reach)
            else:
                stretches.append([max(0, j - reach), min(len(words), j + reach)])
        for lo, hi in stretches:
            out += [(index.ids[k], matched, len(item), lo + a, lo + b) for matched, a, b in passages(item, words[lo:hi], need, mask)]
    return out
