"""Reading level (problem 3): features and a regularised ordinal (cumulative-logit) regression.

The model is trained on the labelled rows of the data at hand (at most ``MAX_LABELS``
of them, by label hash).  Word rarity uses the word counts of every English document,
kept in ``RARITY_BUCKETS`` hashed counters, a fixed-size table whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

RARITY_BUCKETS = 1 << 16
MAX_LABELS = 20_000
BANDS = ("basic", "middle", "advanced")
MIN_WORDS = 60

# Closed-class word lists of English.
SUBORDINATORS = frozenset(
    "although though because since unless while whereas when whenever where if that which who whom whose until after "
    "before as once insofar whether despite notwithstanding".split()
)
CONNECTIVES = frozenset(
    "moreover however therefore furthermore nevertheless consequently thus hence notwithstanding insofar irrespective "
    "contrary whereas although unless despite accordingly nonetheless otherwise meanwhile".split()
)
COORDINATORS = frozenset("and but or so then nor yet for".split())
FUNCTION_WORDS = {
    "en": frozenset("the a an of and is are my our it that with by every this several for from at was they to which when".split()),
    "de": frozenset("der die das den dem des ein eine und ist im bei für mit auf nach zu von nicht sich vor an am jeden".split()),
    "fr": frozenset("le la les l des du de un une et est au aux près pour avec dans sur par ce cette cet sans il".split()),
    "es": frozenset("el la los las del de un una y es al cerca para con en por este esta sin se que antes".split()),
    "it": frozenset("il lo gli del della di un una e è al per con nel da che non si".split()),
    "pt": frozenset("o os as do da de um uma e é ao para com em por não se que no na".split()),
    "nl": frozenset("de het een en is van op met voor in bij naar niet dat die te aan".split()),
}
WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*")
SUFFIX = re.compile(r"(?:isation|ization|ation|ility|ology|ance|ence|ment|ical|ional|ative|ious|ity|ise|ize|ises|izes)s?$")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+|\n+")
NAMES = (
    "len_mean", "len_p90", "word_len", "long10", "long8", "short4", "rarity", "rarity_p90", "ttr", "subord", "subord_max",
    "connect", "coord", "comma", "depth", "depth_p90", "suffix", "syll", "poly", "long_x_len", "simple_share", "hard_share",
)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (RARITY_BUCKETS - 1)


def english(text: str) -> bool:
    """Nine in ten letters are Latin, and English function words outnumber those of every other listed language."""
    letters = sum(map(str.isalpha, text))
    words = [w.lower() for w in WORD.findall(text)]
    if not words or sum(map(len, words)) < 0.9 * letters:
        return False
    seen = Counter(words)
    counts = {lang: sum(map(seen.__getitem__, stop)) for lang, stop in FUNCTION_WORDS.items()}
    en = counts.pop("en")
    return en * 20 >= len(words) and en > max(counts.values())


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def syllables(word: str) -> int:
    return max(1, len(re.findall(r"[aeiouy]+", word)) - (word.endswith("e") and not word.endswith("le")))


#: Facts of the words met so far, a row a word: length, syllables, learned suffix, counter, subordinator, connective, coordinator.
MAX_FACTS = 200_000
_slots: dict[str, int] = {}
_facts = np.zeros((MAX_FACTS, 7))


def word_slots(words: list[str]) -> np.ndarray:
    """Rows of the words in the table of facts, which starts anew when it could not hold them all."""
    global _facts
    if len(_slots) + len(words) > len(_facts):
        _slots.clear()
        if len(words) > len(_facts):
            _facts = np.zeros((len(words), 7))
    out = np.empty(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        k = _slots.get(w)
        if k is None:
            k = _slots[w] = len(_slots)
            _facts[k] = (len(w), syllables(w), SUFFIX.search(w) is not None, bucket(w), w in SUBORDINATORS, w in CONNECTIVES, w in COORDINATORS)
        out[i] = k
    return out


def diversity(ids: np.ndarray, size: int = 100) -> float:
    """Mean type-token ratio over all consecutive windows of ``size`` words (as numbers); of the whole where there are fewer."""
    n = len(ids)
    size = min(size, n)
    last = n - size
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a word is a new type in the windows that begin after its last occurrence and hold it
    at = np.arange(n)
    types = np.maximum(0, np.minimum(at, last) - np.maximum(before, at - size)).sum()
    return float(types) / (size * (last + 1))


def quantile(x: np.ndarray, q: float) -> float:
    """Linear quantile, as numpy's, without its overhead on short arrays."""
    x = np.sort(x)
    at = q * (len(x) - 1)
    k = int(at)
    return float(x[k] + (x[min(k + 1, len(x) - 1)] - x[k]) * (at - k))


def features(text: str, counts: np.ndarray | None = None, total: float = 1.0) -> np.ndarray:
    words: list[str] = []
    sizes: list[int] = []
    commas: list[int] = []
    for s in SENTENCE.split(text):
        w = tokens(s) if s else ()
        if len(w) >= 3:
            words += w
            sizes.append(len(w))
            commas.append(s.count(",") + s.count(";"))
    if not words:
        return np.zeros(len(NAMES))
    ids = word_slots(words)
    f = _facts[ids]
    n, comma = np.array(sizes, dtype=float), np.array(commas, dtype=float)
    starts = np.cumsum([0, *sizes[:-1]])
    # sums by sentence: subordinators, connectives, coordinators, long words
    sub, con, coo, long_ = np.add.reduceat(np.column_stack([f[:, 4:7], f[:, 0] >= 10]), starts).T
    depth = sub + comma * 0.5
    wl = f[:, 0]
    sy = _facts[np.unique(ids), 1]
    rare = np.zeros(1) if counts is None else -np.log((counts[f[:, 3].astype(np.int64)] + 1.0) / (total + RARITY_BUCKETS))
    words_n, long10 = n.sum(), (wl >= 10).mean()
    return np.array([
        np.log(n.mean()), np.log(quantile(n, 0.9)), wl.mean(), long10, (wl >= 8).mean(), (wl <= 4).mean(),
        rare.mean(), quantile(rare, 0.9), diversity(ids), sub.sum() / words_n * 10, sub.max(),
        con.mean(), coo.sum() / words_n * 10, comma.mean(), depth.mean(), quantile(depth, 0.9),
        f[:, 2].mean(), sy.mean(), (sy >= 4).mean(), np.log(n.mean()) * long10, (n <= 8).mean(),
        ((long_ / n > 0.3) | (depth > 3)).mean(),
    ])


class OrdinalModel:
    """Cumulative-logit regression with L2 penalty, fitted by full-batch gradient steps on standardised features."""

    def __init__(self, penalty: float = 1e-2, steps: int = 1500, rate: float = 0.1):
        self.penalty, self.steps, self.rate = penalty, steps, rate

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, z**2 - 1])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "OrdinalModel":
        x, y = np.asarray(x, float), np.asarray(y, int)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._expand(x)
        w = np.zeros(z.shape[1])
        cut = np.array([-1.0, 1.0])
        weight = np.ones(len(y)) if weight is None else weight
        m1, m2 = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
        target = np.stack([y <= 0, y <= 1], 1).astype(float)
        for t in range(1, self.steps + 1):
            p = 1 / (1 + np.exp(-(cut[None, :] - (z @ w)[:, None])))
            d = (p - target) * weight[:, None] / weight.sum()
            g = np.concatenate([-(z.T @ d.sum(1)) + self.penalty * w, d.sum(0)])
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            step = self.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            if t > self.steps * 0.6:
                step *= 0.1
            w -= step[:-2]
            cut -= step[-2:]
            if cut[1] < cut[0] + 1e-3:
                cut[1] = cut[0] + 1e-3
        self.weight, self.cut = w, cut
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._expand(np.atleast_2d(x)) @ self.weight

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.score(x)[:, None] > self.cut[None, :]).sum(1)
