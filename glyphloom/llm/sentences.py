"""Sentence units for every script (problem 4).

Spaceless scripts (Han, kana, Thai) are segmented by the cheapest path through a word lattice of the whole
block: dictionary words, and unknown stretches by kind of script.  Every place at which a sentence
could end (an end mark, a closed quotation, an ellipsis, a Thai space) is a gap; the classes of the words that the path
leaves on both sides of it (final particles, opening words, quotation links, speech verbs, numbers, repetition
signs) and the mark itself carry weights, and the gap ends the sentence where their sum is above zero.

Spaced scripts use a terminator lattice: each run of end marks is a node with a score of its
own (abbreviation, initial, ordinal, ellipsis, enclosure, what follows), and the best path through all nodes of the
block decides together which of them end sentences, as a piece without any word ends none.

Defined results: a null text or null ``block_starts`` gives no sentence for a
null text and one block for null starts; an empty or blank block gives none; a
block without end marks is one sentence; spans are UTF-8 byte offsets, half
open, trimmed of white space.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

# Abbreviations that never end a sentence when a word follows.
INNER_ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st mt fig figs sec no nos nr vol ch pp p art ed eds cf vgl abb bzw ca approx "
    "i.e e.g viz vs z b d h u a s o env c.-à-d m mm mme mlle mgr sr sra srta dra d.ª ud uds pág págs núm "
    "aprox cap gen col capt lt sgt rev hon jan feb mar apr jun jul aug sep sept oct nov dec "
    "см рис стр ок проф ул д им акад гл пер просп пл т.е т.к напр св "
    "hr fr frl str tel bd av mio mrd evtl ggf inkl".split()
)
# Abbreviations that may end a sentence; the next word decides.
FINAL_ABBREVIATIONS = frozenset("usw etc ltd inc co corp jr sr. a.m p.m am pm cie ag gmbh с.ш т.д т.п др".split())
# Month names that follow an ordinal day.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember "
    "jänner january february march may june july october december".split()
)
CLOSERS = "\"”»’'“‘›)]」』》】〉）］｝}＂＇"
SPACELESS_CLOSERS = "\"”»’)]」』》】〉）］｝}＂"
PAIRS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "《": "》", "（": "）",
         "【": "】", "〈": "〉", "［": "］", "‹": "›", "‚": "‘’", "”": "”"}
CLOSE_OF = {c: o for o, cs in PAIRS.items() if o != "”" for c in cs}
END_RUN = re.compile(r"[.!?…。！？．｡।॥؟۔։።፧፨‼⁇⁈⁉;\u037e]+")
LETTER = re.compile(r"[^\W\d_]")
CASELESS = re.compile(r"[֐-ࣿऀ-෿ሀ-᎟฀-໿぀-ヿ㐀-鿿]")
CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
THAI_GAP = re.compile(r"(?<=[\u0e01-\u0e4e\u0e5a-\u0e5b])[ \t\u00a0\u2000-\u200a\u202f\u205f\u3000]+(?=[\u0e01-\u0e4e])")
GREEK = re.compile(r"[Ͱ-Ͽ]")
THAI = re.compile(r"[ก-๛]")
ALNUM = re.compile(r"[^\W_]")
LETTERS = re.compile(r"[^\W\d_]+")
NEXT = re.compile(r"\s*(\S?)")
DASHED = re.compile(r"[—–-]\s*([^\W\d_])")
ORDINAL = re.compile(r"\d{1,2}")
SPACELESS_MARKS = re.compile(r"[。！？!?｡．.…‼⁇⁈⁉]+")
CLAUSE_STOP = re.compile(r"[。！？!?｡]")
LOOKALIKE = str.maketrans("асеорхуіјѕԁһАВЕКМНОРСТХУІЈЅοαερνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijsdhABEKMHOPCTXYIJSoaepviktABEZHIKMNOPTYX")

# Words of the lattice of the spaceless scripts, by class.
CLASSES: dict[str, str] = {
    "speech": "说 问 问道 说道 喊道 答道 叫道 写道 回答 告诉 問 説 言った 言う 言います 言いました 尋ねた 叫んだ 答えた 聞いた 述べた 話した 書いた つぶやいた พูด ถาม ตอบ บอก",
    "link": "と って とは との という といった の は が を に で も へ ว่า",
    "final": "了 吗 呢 吧 啊 呀 嘛 啦 哦 か ね よ わ ぞ な さ かな です ます でした ました ません だ だった である ครับ ค่ะ คะ นะ จ้ะ สิ ล่ะ",
    "opening": (
        "但是 可是 不过 然而 因此 因为 所以 于是 然后 而且 另外 此外 接着 后来 同时 首先 其次 最后 总之 "
        "しかし でも だが だから そして それから それで また さらに ところが ただし つまり なぜなら では すると したがって "
        "แต่ และ ดังนั้น เพราะ เพราะฉะนั้น อย่างไรก็ตาม นอกจากนี้ จากนั้น ต่อมา"
    ),
    "number": "หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า สิบ ร้อย พัน หมื่น แสน ล้าน",
    "repeat": "ๆ",
    "and so on": "ฯลฯ ฯ",
    # content words that hold one of the above and are read as a whole
    "content": (
        "学问 疑问 问题 访问 小说 说明 说服 传说 道路 街道 知道 味道 了解 为了 酒吧 "
        "とても とき ところ とうとう となり ともに とり もう もの もし もっと はい はじめ はず はる がんばる のち のり に関する にわか へや でき できる です "
        "わたし わかる よく よる よい なぜ なに ながら さけ さくら かぜ かわ からだ ねこ ねる ぞう"
    ),
}
LEXICON: dict[str, str] = {w: kind for kind, words in reversed(CLASSES.items()) for w in words.split()}
QUOTE_LINKS = frozenset(w for w, kind in LEXICON.items() if kind == "link")
SPACELESS_RUN = re.compile(r"[ァ-ヺー]+|[A-Za-zＡ-Ｚａ-ｚ]+|[0-9０-９๐-๙.,]+|[ก-ฮะ-ูเ-ๅ][ัิ-ฺ็-๎]*|\s+|.", re.S)
DIGIT = re.compile(r"[0-9０-９๐-๙]")
#: Costs of a path: a dictionary word, one of a single character, an unknown stretch.
WORD_COST, SHORT_COST, UNKNOWN_COST = 1.0, 1.2, 1.5
COMMAS = frozenset("，、,：:")
# Weights of a gap: its mark, and the words beside it.
MARK_WEIGHT = {"full": 3.0, "strong": 1.5, "space": 1.0, "ellipsis": -1.0}
LEFT_WEIGHT = {"final": 0.5, "repeat": -2.0}
RIGHT_WEIGHT = {"opening": 1.0, "repeat": -2.0, "and so on": -2.0}
#: A link right behind a question or exclamation whose clause goes on to a speech verb; a number beside a Thai space.
LINKED, NUMBERED, SEPARATED = -2.5, -2.0, -4.0

_automata: dict[int, object] = {}


def _automaton(lexicon: dict[str, str]):
    """The words of a lexicon as an automaton, one a lexicon and process."""
    held = _automata.get(id(lexicon))
    if held is None or held[0] is not lexicon:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in lexicon:
            auto.add_word(w, len(w))
        auto.make_automaton()
        held = _automata[id(lexicon)] = (lexicon, auto)
    return held[1]


def lattice_words(text: str, lexicon: dict[str, str] = LEXICON) -> list[str]:
    """Cheapest path through the word lattice of a text: dictionary words against unknown stretches (a run of kana, letters or digits, else one character)."""
    n = len(text)
    if not n:
        return []
    edges: dict[int, list[tuple[int, float]]] = {}
    if lexicon:
        for last, size in _automaton(lexicon).iter(text):
            edges.setdefault(last + 1 - size, []).append((last + 1, WORD_COST if size > 1 else SHORT_COST))
    stop = {m.start(): m.end() for m in SPACELESS_RUN.finditer(text)}
    far = float("inf")
    best: list[float] = [0.0] + [far] * n
    back = [0] * (n + 1)
    for i in range(n):
        at = best[i]
        if at == far:
            continue
        end = stop.get(i, i + 1)
        if at + UNKNOWN_COST < best[end]:
            best[end], back[end] = at + UNKNOWN_COST, i
        for end, cost in edges.get(i, ()):
            if at + cost < best[end]:
                best[end], back[end] = at + cost, i
    words, i = [], n
    while i:
        words.append(text[back[i] : i])
        i = back[i]
    return words[::-1]


class Path:
    """The words of a block, by place, with the classes of the lexicon."""

    def __init__(self, text: str, lexicon: dict[str, str] = LEXICON):
        self.lexicon = lexicon
        self.words = lattice_words(text, lexicon)
        self.at = [0, *accumulate(map(len, self.words))]

    def kind(self, word: str) -> str:
        return "number" if DIGIT.match(word) else self.lexicon.get(word, "")

    def before(self, place: int) -> str:
        """The last word that ends at ``place`` or before it, white space aside."""
        k = bisect_left(self.at, place)
        k -= self.at[k] > place
        while k > 0 and self.words[k - 1].isspace():
            k -= 1
        return self.words[k - 1] if k > 0 else ""

    def after(self, place: int) -> str:
        """The first word that begins at ``place`` or behind it, white space aside."""
        k = bisect_left(self.at, place)
        while k < len(self.words) and self.words[k].isspace():
            k += 1
        return self.words[k] if k < len(self.words) else ""

    def between(self, a: int, b: int) -> list[str]:
        """The words that begin in [a, b), white space aside."""
        return [w for w in self.words[bisect_left(self.at, a) : bisect_left(self.at, b)] if not w.isspace()]


def gap_weight(mark: str, left: str, right: str) -> float:
    """What a mark and the classes of the words beside it say for an end of sentence."""
    return MARK_WEIGHT[mark] + LEFT_WEIGHT.get(left, 0.0) + RIGHT_WEIGHT.get(right, 0.0)


def quotation_weight(path: Path, lead_place: int, lead_mark: str, after: list[str]) -> float:
    """The same for the gap behind a closed quotation that ends with an end mark.

    A quotation that completes its clause speaks for an end; a quotation link or a speech
    verb behind the gap opens the rest of the sentence.  A final particle inside the
    quotation tells nothing here, as a speech verb may follow it all the same.
    """
    if after and path.kind(after[0]) == "link":
        return MARK_WEIGHT["strong"] + LINKED
    complement = lead_mark in "：:，,、" and lead_mark != "" or path.kind(path.before(lead_place)) == "speech"
    return 1.0 if complement or not any(path.kind(w) == "speech" for w in after) else -1.0


def _enclosures(block: str) -> list[tuple[int, int]]:
    """Matched quotation and bracket pairs of a block; a mark without its partner encloses nothing."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    straight = -1
    for m in re.finditer(r"[“”„«»()\[\]「」『』《》（）【】〈〉［］‹›\"＂]", block):
        c, i = m[0], m.start()
        if c in "\"＂":
            if straight < 0:
                straight = i
            else:
                out.append((straight, i))
                straight = -1
            continue
        if c == "“" and any(o == "„" for o, _ in stack):
            c = "”"
        if c in PAIRS and c != "”":
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[k][0]]:
                out.append((stack[k][1], i))
                del stack[k:]
                break
    return out


_INNER = {w.translate(LOOKALIKE) for w in INNER_ABBREVIATIONS}
_FINAL = {w.translate(LOOKALIKE) for w in FINAL_ABBREVIATIONS}


class _Held:
    """The enclosures of a block: what covers a span, and what closes inside one."""

    def __init__(self, pairs: list[tuple[int, int]]):
        pairs = sorted(pairs)
        self.starts = [a for a, _ in pairs]
        self.reach = list(accumulate((b for _, b in pairs), max))
        self.opened = {b: a for a, b in pairs}

    def over(self, i: int, k: int) -> bool:
        """Whether an enclosure opened before ``i`` closes at ``k`` or later."""
        n = bisect_left(self.starts, i)
        return n > 0 and self.reach[n - 1] >= k

    def closing(self, i: int, k: int) -> tuple[int, int] | None:
        """The outermost enclosure opened before ``i`` that closes after ``i`` and before ``k``."""
        found = [(a, b) for b in range(i + 1, k) if (a := self.opened.get(b)) is not None and a < i]
        return min(found) if found else None


def _inner(word: str) -> bool:
    return unicodedata.normalize("NFKC", word).lower().translate(LOOKALIKE) in _INNER


def _final(word: str) -> bool:
    return unicodedata.normalize("NFKC", word).lower().translate(LOOKALIKE) in _FINAL


class _Ahead:
    """The next letter or digit behind a place, looked for once a stretch."""

    def __init__(self, block: str):
        self.block, self.known, self.since = block, -1, -1

    def __call__(self, place: int) -> str:
        if not self.since <= place <= self.known:
            m = ALNUM.search(self.block, place)
            self.since, self.known = place, m.start() if m else len(self.block)
        return self.block[self.known : self.known + 1]


def _last_word(block: str, stop: int) -> tuple[str, int]:
    """The run of non-space characters before ``stop`` and where it begins."""
    a = stop
    while a > 0 and not block[a - 1].isspace():
        a -= 1
    return block[a:stop], a


def _period_score(block: str, i: int, k: int, ahead: _Ahead) -> float:
    """How far a single period at ``i``, its closers taken up to ``k``, ends a sentence: above zero for an end."""
    word, a = _last_word(block, i)
    word = word.lstrip("(\"“„«'‘[¿¡—-")
    first = ahead(k)
    nxt = NEXT.match(block, k)[1]
    upper = first.isupper() or (first != "" and not first.islower() and not first.isdigit())
    if not word:
        return 1.0
    if _final(word):
        return -2.0 if first.islower() else 1.0
    bare = word.rstrip(".")
    if len(bare) == 1 and LETTER.match(bare):
        # initials, "z. B.", "d. h.", "a. m.", "т. д."
        if first.islower() or first.isdigit():
            return -2.0
        b = a
        while b > 0 and block[b - 1].isspace():
            b -= 1
        low, prev = bare.lower().translate(LOOKALIKE), _last_word(block, b)[0].lower().translate(LOOKALIKE)
        return 1.0 if low == "m" and prev in ("a.", "p.") or low in ("д", "п") and prev == "т." else -2.0
    if _inner(word):
        return 1.0 if first == "" or not nxt else -2.0
    if ORDINAL.fullmatch(bare):
        month = LETTERS.match(block, NEXT.match(block, k).start(1))
        return -2.0 if month and month[0].lower() in MONTHS else 1.0
    if "." in bare and len(bare) <= 6 and LETTER.search(bare) and all(len(x) <= 2 for x in bare.split(".")):
        return 1.0 if upper else -2.0
    return 1.0


#: A node that cannot end a sentence, and the cost of an end that closes a piece without any word.
NEVER, WORDLESS = -9.0, -3.0


def _terminators(block: str, held: _Held) -> Iterator[tuple[int, float]]:
    """(place behind the closers, score) of every run of end marks of a spaced script."""
    last = len(block.rstrip())
    greek = len(GREEK.findall(block)) * 2 > len(LETTER.findall(block))
    ahead = _Ahead(block)
    n = len(block)
    caseless = None
    for m in END_RUN.finditer(block):
        run, i, j = m[0], m.start(), m.end()
        if set(run) <= set(";\u037e") and not greek:
            continue
        k = j
        while k < n and block[k] in CLOSERS and (block[k] not in "“‘" or not block[k + 1 : k + 2].isalnum()):
            k += 1
        # French spacing before a closing mark
        if k < n and block[k].isspace():
            q = k
            while q < n and block[q].isspace() and block[q] != "\n":
                q += 1
            if q < n and block[q] == "»":
                k = q + 1
        # within a word or number, or inside an enclosure that is still open after the closers taken
        if k < n and not block[k].isspace() or held.over(i, k):
            continue
        if k >= last:
            yield k, -NEVER
            return
        if "…" in run or "..." in run:
            yield k, NEVER
            continue
        nxt = NEXT.match(block, k)
        first = nxt[1]
        quoted = held.closing(i, k) is not None
        score = 1.0
        if quoted or (k > j and block[k - 1] in "'’"):
            if first in ",;:—–-" or first.islower():
                score = NEVER
            elif CASELESS.match(first):
                score = NEVER
            elif first.isdigit():
                caseless = CASELESS.search(block) is not None if caseless is None else caseless
                score = NEVER if caseless else score
        elif first in "—–-":
            clause = DASHED.match(block, nxt.start(1))
            score = NEVER if clause and clause[1].islower() else score
        elif first in ",;:":
            score = NEVER
        if score > 0 and run in (".", "．") and not quoted:
            score = _period_score(block, i, k, ahead)
        yield k, score


def _spaced_ends(block: str, held: _Held) -> list[int]:
    """The best path through the terminator lattice: every node ends a sentence or does not."""
    ends: list[int] = []
    for place, score in _terminators(block, held):
        if score <= 0:
            # leaving the node out is the better step from any path
            continue
        worded = ALNUM.search(block, ends[-1] if ends else 0, place) is not None
        if ends and not worded and score + WORDLESS <= 0:
            # an end here and one before it cost more than one of the two: the later one keeps stray marks with their sentence
            ends[-1] = place
        else:
            ends.append(place)
    return ends


def _spaceless_ends(block: str, held: _Held, lexicon: dict[str, str] = LEXICON) -> list[int]:
    """Gaps of Han and kana at which a sentence ends, classified over the lattice path of the block."""
    ends: list[int] = []
    last = len(block.rstrip())
    n = len(block)
    path = Path(block, lexicon)

    def clause(k: int) -> list[str]:
        stop = CLAUSE_STOP.search(block, k)
        return path.between(k, stop.start() if stop else n)

    start = 0
    for m in SPACELESS_MARKS.finditer(block):
        run, i, j = m[0], m.start(), m.end()
        if i < start:
            continue
        k = j
        while k < n and block[k] in SPACELESS_CLOSERS:
            k += 1
        ellipsis = set(run) <= set("…") or run.startswith("...")
        if not ellipsis and set(run) <= set(".．") and not (k == n or block[k].isspace()) or held.over(i, k):
            continue
        if k >= last:
            break
        follower = path.after(k)
        right = path.kind(follower)
        holder = held.closing(i, k)
        if holder:
            if ellipsis:
                continue
            a, b = holder
            lead = a
            while lead > start and block[lead - 1].isspace():
                lead -= 1
            mark = block[lead - 1] if lead > start else ""
            weight = quotation_weight(path, lead, mark, clause(k))
            if block[b] in "）)】]" and mark and (right == "link" or mark not in "。！？"):
                weight += SEPARATED
            if follower in COMMAS:
                weight += SEPARATED
        else:
            kind = "ellipsis" if ellipsis else "strong" if set(run) & set("！？!?‼⁇⁈⁉") else "full"
            weight = gap_weight(kind, path.kind(path.before(i)), right)
            if kind == "strong" and right == "link" and any(path.kind(w) == "speech" for w in clause(k)):
                weight += LINKED
        if weight > 0:
            ends.append(k)
            start = k
    return ends


def _thai_ends(block: str, lexicon: dict[str, str] = LEXICON) -> list[int]:
    """Thai spaces at which a sentence ends: between letters, with no number or repetition sign beside them."""
    gaps = list(THAI_GAP.finditer(block))
    if not gaps:
        return []
    path = Path(block, lexicon)
    ends = []
    for m in gaps:
        left, right = path.kind(path.before(m.start())), path.kind(path.after(m.end()))
        if gap_weight("space", left, right) + (NUMBERED if "number" in (left, right) else 0.0) > 0:
            ends.append(m.start())
    return ends


def block_sentences(block: str, lexicon: dict[str, str] = LEXICON) -> Iterator[tuple[int, int]]:
    """Trimmed code-point spans of the sentences of one block."""
    thai = THAI.search(block)
    cjk = len(CJK.findall(block))
    letters = len(LETTER.findall(block)) or 1
    held = _Held(_enclosures(block))
    if cjk * 2 > letters:
        ends = _spaceless_ends(block, held, lexicon)
    else:
        ends = _spaced_ends(block, held)
        if thai:
            ends = sorted({*ends, *_thai_ends(block, lexicon)})
    start = 0
    for end in [*ends, len(block)]:
        a, b = start, end
        while a < b and block[a].isspace():
            a += 1
        while b > a and block[b - 1].isspace():
            b -= 1
        if b > a and end > start:
            yield a, b
        start = max(start, end)


def view_sentences(text: str | None, block_starts: list[int] | None, lexicon: dict[str, str] = LEXICON) -> list[tuple[int, int]]:
    """UTF-8 byte spans of all sentences of a norm view."""
    if not text:
        return []
    raw = text.encode("utf-8")
    size = len(raw)
    cuts = sorted({int(s) for s in block_starts if s is not None and 0 <= s < size}) if block_starts is not None else []
    if not cuts or cuts[0] != 0:
        cuts = [0, *cuts]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, [*cuts[1:], size], strict=True):
        block = raw[a:b].decode("utf-8", "replace")
        plain = len(block) == b - a
        at = 0
        done = 0
        for s, e in block_sentences(block, lexicon):
            if plain:
                out.append((a + s, a + e))
                continue
            at += len(block[done:s].encode("utf-8"))
            first = at
            at += len(block[s:e].encode("utf-8"))
            done = e
            out.append((a + first, a + at))
    return out
