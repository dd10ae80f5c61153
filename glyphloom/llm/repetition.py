"""Repetition inside one document (problem 2): measures, host rules, host verdicts."""

from __future__ import annotations

import re

import numpy as np

from glyphloom.llm.textforms import INVISIBLE as FORMS_INVISIBLE

RUN = 6
# Combining marks that belong to the letter before them.
MARKS = "\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u135d-\u135f"
LETTERS = re.compile(rf"(?:[^\W_]|[{MARKS}])+")
PLAIN = re.compile(r"[a-z0-9]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
INVISIBLE = re.compile("[" + FORMS_INVISIBLE + "]")
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]")


def words_of(text: str) -> list[str]:
    """Case-folded words, punctuation and invisible characters aside; combining marks stay with their letters."""
    if text.isascii():
        return PLAIN.findall(text.lower())
    text = INVISIBLE.sub("", text).casefold()
    return LETTERS.findall(text)


def spaced(text: str) -> bool:
    """Written with spaces between words: under a quarter of the letters belong to spaceless scripts."""
    spaceless = len(SPACELESS.findall(text))
    return spaceless * 4 < sum(map(str.isalpha, text)) if spaceless else True


def covered_mask(words: list[str], run: int = RUN) -> np.ndarray:
    """True for each word inside a run of ``run`` or more words that already occurred earlier in the text.

    A run is looked up by exact word ids; an earlier occurrence may overlap the run (``a a a a a a a``).
    """
    n = len(words)
    mask = np.zeros(n, dtype=bool)
    if n <= run:
        return mask
    ids: dict[str, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    # rolling 64-bit keys rule out the common case; hits are verified on the exact ids
    a = np.array(seq, dtype=np.uint64)
    key = np.zeros(n - run + 1, dtype=np.uint64)
    for k in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + a[k : n - run + 1 + k] + np.uint64(1)
    if len(np.unique(key)) == len(key):
        return mask
    first: dict[tuple, int] = {}
    reach = -1
    for i in range(n - run + 1):
        gram = tuple(seq[i : i + run])
        if gram in first:
            mask[max(i, reach) : i + run] = True
            reach = i + run
        else:
            first[gram] = i
    return mask


EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def written_words(text: str) -> list[str]:
    """The other reading of words: what stands between spaces, its outer punctuation aside (``don't`` and ``well-known`` are one)."""
    return [w for x in INVISIBLE.sub("", text).casefold().split() if (w := EDGES.sub("", x))]


def shares(text: str, words: list[str]) -> tuple[float, float]:
    """Share of words in repeated runs by both readings of a word.

    Every written word holds one or more of ``words``, so a text without a repeated run of these has none of those.
    """
    share = float(covered_mask(words).sum()) / len(words) if words else 0.0
    if not share:
        return 0.0, 0.0
    other = written_words(text)
    return share, float(covered_mask(other).sum()) / len(other) if other else 0.0


def repeated_share(text: str | None) -> float:
    """Share of the words in repeated runs alone."""
    words = words_of(text) if text else []
    return float(covered_mask(words).sum()) / len(words) if words else 0.0


def measures(text: str | None) -> tuple[int, float, float, float, float, float]:
    """(words, share of words in repeated runs, the same for written words, repeated sentences, top bigram share, repeated lines)."""
    words = words_of(text) if text else []
    n = len(words)
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    share, other = shares(text, words)

    def repeated(parts: list[str]) -> float:
        seen: set[str] = set()
        total = again = 0
        for p in parts:
            key = " ".join(WORD.findall(p.casefold()))
            if not key:
                continue
            total += len(key)
            if key in seen:
                again += len(key)
            seen.add(key)
        return again / total if total else 0.0

    sentences = repeated(re.split(r"[.!?…。！？।۔؟։።]+|\n", text))
    lines = repeated(text.split("\n"))
    top = 0.0
    if n > 1:
        counts: dict[tuple[str, str], int] = {}
        for a, b in zip(words, words[1:]):
            counts[a, b] = counts.get((a, b), 0) + 1
        (a, b), k = max(counts.items(), key=lambda x: x[1])
        top = k * (len(a) + len(b)) / sum(map(len, words)) if k > 1 else 0.0
    return n, share, other, sentences, top, lines
