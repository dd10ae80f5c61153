"""Personal details in free text (problem 8): anchor expansion.

An Aho-Corasick automaton over a folded text (widths, look-alikes, accents and invisible
characters evened out, offsets kept) finds anchors: at-signs, schemes, identifier and
contact cues, street words, parts of personal names.  A local parser expands each anchor
to both sides, as far as its parts go, and validates what it finds.  Digits are anchors, too: the first
of a run is what the parsers of phone numbers and bare identity numbers start from.  No parser looks through a
window of fixed size; an address and a cue reach to the end of their line or sentence.  Names are read in
every script: cased ones by their capitals, caseless ones (Han, kana, Arabic) by listed parts side by side or
a listed part with an honorific or a cue.

Defined results: null or empty text holds nothing; spans are 0-based half-open code-point
offsets in the text as given; overlapping candidates keep the longer span, then the kind
that stands first in ``KINDS``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass, field

from glyphloom.llm.textforms import ALIKE, COMPAT, INVISIBLE

KINDS = ("email", "id_number", "address", "phone", "name")

# Cues of identity papers, folded to lower case without accents.
ID_CUES = (
    "social security|national insurance|insurance no|insurance number|passport|id card|identity card|identity number|"
    "tax id|tax no|tax number|taxpayer|driving licence|driver license|nino|ssn|personal id|"
    "ausweis|steuer-id|steuernummer|steueridentifikation|sozialversicherung|reisepass|fuhrerschein|rentenversicherung|"
    "securite sociale|passeport|carte d'identite|numero fiscal|numero d'identite|permis de conduire|"
    "seguridad social|pasaporte|dni|nie|numero de identidad|nif|"
    "паспорт|снилс|инн|"
    "身份证|护照|社会保险|社保|税号|纳税人|驾驶证|旅券番号|旅券|パスポート|マイナンバー|個人番号|免許証|保険証|年金番号|納税者番号|社会保障番号"
).split("|")
# Words before a number that is no personal number.
NOT_PERSONAL = re.compile(
    r"(?:order|part|isbn|issn|ticket|build|version|invoice|serial|model|balance|account balance|item|auftrag|bestellung|rechnung|"
    r"commande|facture|pedido|factura|saldo|solde|kontostand|注文|订单|発注|票|番号第|余额|残高|no\. of|batch|lot)(?: no\.?| nr\.?| number| n°)?[\s:#]*$"
)
CALL_CUES = re.compile(
    r"(?:tel|phone|call|mobile|cell|fax|contact|reach|ring|dial|whatsapp|telefon|rufen sie|anruf|handy|appelez|telephone|portable|"
    r"llame|telefono|movil|тел|телефон|电话|電話|手机|携帯|ファックス|传真|致电|拨打|または|or|oder|ou)[\s.:=;(]*$"
)
# Street words.
EN_STREETS = (
    "street st road rd lane ln way close terrace terr avenue ave boulevard blvd drive dr court ct place pl square sq "
    "crescent cres grove hill row walk mews gardens parade quay circle highway hwy parkway pkwy alley rise yard green"
).split()
DE_STREETS = (
    "strasse|stra.e|str\\.|gasse|weg|stieg|platz|allee|ufer|damm|ring|steig|pfad|hof|graben|chaussee|markt|winkel|zeile|kamp|berg"
)
FR_STREETS = "rue|bd|boulevard|avenue|av\\.|impasse|place|chemin|allee|quai|route|cours|square|passage|sentier|ruelle|faubourg"
ES_STREETS = "calle|avenida|plaza|paseo|camino|carretera|ronda|travesia"
TITLES = frozenset("mr mrs ms miss dr prof frau herr herrn mme mlle m sr sra srta don dona".split())
# What follows a family name when it names a place, firm or thing.
NOT_PERSON_AFTER = re.compile(
    r"(?:['’]s)?[\s-]+(?:ltd|llc|inc|gmbh|ag|co|corp|plc|sa|sarl|bridge|road|street|st|square|hall|house|museum|school|park|river|"
    r"station|company|brothers|& sons|and sons|brucke|stra.e|strasse|platz|werke|verlag|bank|hotel|farm|mill|theatre|theater|college|"
    r"university|hospital|library|prize|award|effect|theorem|law|act|county|valley|lake|island|street)\b"
    r"|(?:橋|桥|公司|株式会社|大桥|通り|駅|站|学校|路|社|湖|山|川|河)"
)
NOT_PERSON_BEFORE = re.compile(
    r"(?:\b(?:pont|rue|avenue|societe|maison|lac|gare|place|puente|calle|firma|hotel|rio|the|le|la|der|die|das|el)\s+)$"
)
PARTICLES = ("van der", "van den", "van", "von", "de la", "de", "di", "da", "del", "della", "du", "ter", "le", "al", "bin")
NAME_CUES = re.compile(
    r"(?:dear|ask for|issued to|signed:?|chairs?:|taken by|applicant|parcel to|thanks in advance,|regards,|sincerely,|reach|belongs to|"
    r"geehrte frau|geehrter herr|gehort|fragen sie nach|paket geht an|chere?|demandez|ecrivez a|part chez|au nom de|"
    r"请联系|尊敬的|联系人|担当は|電話して|致电)[\s:]*$"
)
# Capital and small letters of the cased scripts, as they stand after folding.
CAPITALS = "A-ZÆØÞŁĐŒΑ-ΩЀ-ЯԱ-Ֆ"
SMALL = "a-zæøþłđœßα-ωа-џա-և"
CAP = f"[{CAPITALS}][{SMALL}]+"
UP = f"[{CAPITALS}]{{3,}}"
SPACELESS = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
HONORIFIC = re.compile(r"[ ]?(?:様|さん|氏|先生|女士|小姐|君)")
PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
FAMILY = rf"(?:{PARTICLE} )?(?:{CAP}|{UP})(?:-(?:{CAP}|{UP}))?"
GIVEN_AFTER = re.compile(rf"(?:-{UP})? ({CAP})(?: [{CAPITALS}]\.(?![{CAPITALS}{SMALL}]))?")
FAMILY_AFTER = re.compile(rf"(?:\s(?:[{CAPITALS}]\.\s)*)({FAMILY})")
PARTICLE_AFTER = re.compile(rf"\s(?:[{CAPITALS}]\.\s)*{PARTICLE} ")
INITIALS_AFTER = re.compile(rf"\s(?:[{CAPITALS}]\.\s)+")
INITIAL_END = re.compile(rf"\s[{CAPITALS}]\.(?=\s*\Z|\s*[,;)\n])")
DOUBLE_AFTER = re.compile(rf"-{CAP}(?: {FAMILY})?")
JOINED_AFTER = re.compile(rf"-(?:{CAP}|{UP})")
INITIALS_BEFORE = re.compile(rf"((?:(?<![{CAPITALS}{SMALL}0-9])[{CAPITALS}]\. ?)+)((?:{PARTICLE} )?)$")
GIVEN_BEFORE = re.compile(rf"({CAP}) ((?:{PARTICLE} )?)$")
CUED_BEFORE = re.compile(rf"(?<![{CAPITALS}{SMALL}0-9])({CAP}(?: [{CAPITALS}]\.)?) ((?:{PARTICLE} )?)$")
TITLE_BEFORE = re.compile(r"(?i:\b(?:mr|mrs|ms|miss|dr|prof|frau|herrn?|mme|mlle|monsieur|madame|sr|sra)\.?\s)$")
INITIAL = re.compile(rf"(?:[{CAPITALS}]\.)+")
SENTENCE_END = re.compile(r"[\n;。！？]|[.!?] (?=[A-Z][a-z])")
#: Longest phrase of ``NOT_PERSONAL`` and ``CALL_CUES``, white space and marks behind it aside.
CUE_LENGTH = 32


def letter(c: str) -> bool:
    """A letter of a script that is written with spaces."""
    return c.isalpha() and (c < "\x80" or not SPACELESS.match(c))


def phrase_before(low: str, at: int) -> str:
    """What may be a cue right before a place: marks and white space are passed over first, however many."""
    b = at
    while b > 0 and low[b - 1] in " \t\r\n:#.=;(":
        b -= 1
    return low[max(0, b - CUE_LENGTH) : at]


def words_before(t: str, at: int, most: int = 8) -> str:
    """The text of the last ``most`` words before a place on its line; initials count for nothing, and of a spaceless script what a cue can hold."""
    b = at
    spaceless = 0
    while most > 0 and spaceless <= CUE_LENGTH:
        q = b
        while q > 0 and t[q - 1].isspace() and t[q - 1] != "\n":
            q -= 1
        r = q
        while r > 0 and not t[r - 1].isspace() and spaceless <= CUE_LENGTH:
            r -= 1
            spaceless += t[r] >= "\x80" and SPACELESS.match(t[r]) is not None
        if r == q:
            break
        most -= INITIAL.fullmatch(t, r, q) is None
        b = r
    return t[b:at]


@dataclass
class NameModel:
    """Parts of personal names: the listed ones, and the productive stems and endings learned from the list."""

    listed: dict[str, set[str]] = field(default_factory=dict)
    stems: dict[str, set[str]] = field(default_factory=dict)
    ends: dict[str, set[str]] = field(default_factory=dict)

    def kinds(self, token: str) -> set[str]:
        t = token.lower()
        out = set(self.listed.get(t, ()))
        if len(t) >= 5:
            for kind in ("given", "family"):
                stems, ends = self.stems.get(kind, set()), self.ends.get(kind, set())
                if any(t[:i] in stems and t[i:] in ends for i in range(2, len(t) - 1)):
                    out.add(kind)
        return out


def plain(text: str) -> tuple[str, list[int] | None]:
    """Folded text without accents and invisible characters, and the source offset of every character."""
    if text.isascii():
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if c < "\x80":
            out.append(c)
            at.append(i)
            continue
        if c in INVISIBLE:
            continue
        c = COMPAT.get(c, c)
        c = ALIKE.get(c, c)
        if c >= "\x80":
            if unicodedata.combining(c):
                continue
            if c.isdigit():
                try:
                    c = str(unicodedata.digit(c))
                except ValueError:
                    pass
            elif c.isalpha() and not ("぀" <= c <= "鿿"):
                d = unicodedata.normalize("NFKD", c)
                c = "".join(ALIKE.get(x, x) for x in d if not unicodedata.combining(x)) or c
                c = c.replace("ß", "ss") if c == "ß" else c
        for x in c:
            out.append(x)
            at.append(i)
    return "".join(out), at


def learn_names(rows: list[tuple[str | None, str | None]], least: int = 3) -> NameModel:
    """Listed parts, and every stem/ending split in which both sides recur with ``least`` different partners.

    The list is a dictionary table (a documented input of this operator); part kinds that are
    null or contradicted by the endings of the rest count for both kinds.
    """
    model = NameModel()
    parts: dict[str, set[str]] = {}
    for part, kind in rows:
        if not part:
            continue
        t = plain(part.strip())[0].lower()
        if len(t) < 2 and not SPACELESS.match(t):
            continue
        parts.setdefault(t, set()).add((kind or "").strip().lower())
    for kind in ("given", "family"):
        words = [t for t, ks in parts.items() if kind in ks]
        by_stem: dict[str, set[str]] = {}
        by_end: dict[str, set[str]] = {}
        for t in words:
            for i in range(2, len(t) - 1):
                by_stem.setdefault(t[:i], set()).add(t[i:])
                by_end.setdefault(t[i:], set()).add(t[:i])
        stems = {s for s, e in by_stem.items() if len(e) >= least and len(s) >= 2}
        ends = {e for e, s in by_end.items() if len(s) >= least and len(e) >= 2}
        # keep splits in which stem and ending support each other
        stems = {s for s in stems if len(by_stem[s] & ends) >= least}
        ends = {e for e in ends if len(by_end[e] & stems) >= least}
        model.stems[kind] = {s for s in stems if len(s) >= 3}
        model.ends[kind] = {e for e in ends if len(e) >= 2}
    for t, ks in parts.items():
        kinds = {k for k in ks if k in ("given", "family")}
        for kind in ("given", "family"):
            if any(t[:i] in model.stems[kind] and t[i:] in model.ends[kind] for i in range(2, len(t) - 1)):
                kinds.add(kind)
        model.listed[t] = kinds or {"given", "family"}
    return model


AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?|\s(?:AT)\s)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|Dot|punkt|point)\s?[)\]}]\s?)"
EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9_%+-]*(?:\.[A-Za-z0-9_%+-]+)*)" + AT
    + r"([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:" + DOT + r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*" + DOT + r"[A-Za-z]{2,})(?![A-Za-z0-9])"
)
PHONE = re.compile(
    r"(?<![\w.@/-])(?:\+|00)?\(?\d(?:[\d]|[ .\-/]{1}(?=[\d(])|\s?\((?=\d)|\)[ .\-]?(?=\d))+\d(?![\d])"
)
ID_FORMS = [
    re.compile(r"(?<![A-Za-z0-9])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![A-Za-z0-9])"),
    re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
]
ID_VALUE = re.compile(r"[A-Z0-9](?:[A-Z0-9]|[ .\-/](?=[A-Z0-9]))*")
EN_ADDRESS = re.compile(
    r"(?<![\w])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d{1,4}[A-Za-z]?, ?)?\d{1,5}[A-Za-z]?(?:-\d{1,5})?,? (?:[A-Z][A-Za-z'’]+ ){1,4}?"
    r"(?:" + "|".join(x.capitalize() for x in EN_STREETS) + r")\b\.?"
    r"(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite|#) ?\d{1,4}[A-Za-z]?)?"
    r"(?:, ?(?P<town>[A-Z][A-Za-z'’-]+(?: [A-Z][A-Za-z'’-]+){0,2}))?(?P<code>,? (?:[A-Z]{2} )?\d{5}(?:-\d{4})?\b(?!\s?(?:km|lamps|boats))|,? [A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}\b)?"
)
DE_ADDRESS = re.compile(
    r"(?<![\w])(?:(?:Am|An der|An den|Im|In der|In den|Auf der|Auf dem|Zum|Zur|Bei der|Beim|Unter den|Alte|Alter|Neue|Neuer|Grosse|Kleine|Obere|Untere|Hinter der|Vor dem)"
    r"(?: [A-Z][A-Za-z.\-]+){1,2}|[A-Z][A-Za-z\-]*(?: ?(?:" + DE_STREETS + r"|Strasse|Stra.e|Gasse|Weg|Platz|Allee))(?![A-Za-z]))"
    r" \d{1,4} ?[a-z]?(?:-\d+)?(?![\d])(?:, (?:(?:Whg|Wohnung|App)\.? \d+, )?(?:D-)?(?:\d{5} )?[A-Z][A-Za-z\-]+(?: (?:am|an der|im|bei) [A-Z][A-Za-z]+)?)?"
)
FR_ADDRESS = re.compile(
    r"(?<![\w])\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:" + FR_STREETS + r")(?: (?:de la|de l'|des|du|de|d'|la|le|les)?['’]? ?[A-Za-z'’\-]+){1,5}?"
    r"(?:, (?:appt|apt|bat)\.? \d+)?, (?:\d{5} )?[A-Z][A-Za-z'’\-]+(?: [A-Z][A-Za-z\-]+)*"
)
ES_ADDRESS = re.compile(
    r"(?<![\w])(?i:" + ES_STREETS + r")(?: (?:de la|de los|de las|del|de|el|la))?(?: [A-Z][A-Za-z\-]+){1,4},? (?:n\.? ?)?\d{1,4}(?:, \d+ ?[A-Za-z]?)?(?:, (?:\d{5} )?[A-Z][A-Za-z\-]+)?"
)
CJK_WORD = r"[぀-ヿ㐀-鿿々ー]"
JA_ADDRESS = re.compile(
    r"(?:〒?\d{3}-\d{4} ?)?(?:[ァ-ヺー一-鿿々]{1,8}[都道府県])?[ァ-ヺー一-鿿々]{1,16}?[市区町村郡](?:[ァ-ヺー一-鿿々]{1,10}?[市区町村])?[ァ-ヺーぁ-ん一-鿿々]{0,10}?\d{1,3}(?:丁目|番地?|号|-)\d{0,4}(?:番地?|号|-\d{1,4})*(?:号室?)?(?:[ ]?[ァ-ヺー一-鿿]{2,12}\d{2,4}号室)?"
)
ZH_ADDRESS = re.compile(
    r"(?:[一-鿿]{2,8}?省)?[一-鿿]{1,8}?(?:市|县|镇)(?:[一-鿿]{1,6}?[区县镇])?[一-鿿]{1,8}?(?:路|街|大道|巷|弄|道)\d{1,5}号?(?:[ ]?\d{1,4}(?:栋|幢|号楼|单元|室|弄|号|楼))*(?:，? ?\d{6})?"
)


DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


LEAD = re.compile(r".*(?:は|、|，|在|于|到|寄到|寄往|に|で|を|：|:|址)")
DE_TIME = re.compile(r"(?:Am|Im) (?:\d|Markttag|Winter|Abend)")


class Finder:
    """Holds the automaton and the parsers of one worker."""

    def __init__(self, model: NameModel):
        import ahocorasick

        self.model = model
        self.longest = max(map(len, model.listed), default=0)
        self.auto = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}

        def add(word: str, kind: str) -> None:
            anchors.setdefault(word, set()).add(kind)

        for w in ("@", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", "mailto:", " at "):
            add(w, "email")
        for w in ID_CUES:
            add(plain(w)[0].lower(), "id")
        for w in EN_STREETS:
            add(" " + w, "en")
        for w in "strasse str. gasse weg stieg platz allee ufer damm ring steig pfad hof graben chaussee markt winkel zeile kamp berg".split():
            add(w, "de")
        for w in ("am ", "an der ", "im ", "zum ", "zur ", "auf der ", "in der "):
            add(w, "de")
        for w in FR_STREETS.replace("\\", "").split("|"):
            add(f"{w} ", "fr")
        for w in ES_STREETS.split("|"):
            add(f"{w} ", "es")
        for w in ("丁目", "番地", "町", "市", "区"):
            add(w, "ja")
        for w in ("路", "街", "大道", "巷"):
            add(w, "zh")
        for d in "0123456789":
            add(d, "digit")
        for stems in self.model.stems.values():
            for s in stems:
                add(s, "name")
        for s in self.model.listed:
            add(s, "name")
        for w, ks in anchors.items():
            self.auto.add_word(w, (len(w), frozenset(ks)))
        self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        t, at = plain(text)
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        spots: dict[str, list[int]] = {}
        for end, (size, kinds) in self.auto.iter(low):
            start = end - size + 1
            for k in kinds:
                # a cue in Latin letters is a word of its own; a short one also ends there
                if k == "id" and low[start] < "\x80" and (
                    start and low[start - 1].isalnum() and low[start - 1] < "\x80" or size <= 4 and low[end + 1 : end + 2].isalnum() and low[end + 1] < "\x80"
                ):
                    continue
                spots.setdefault(k, []).append(start)
        found: list[tuple[int, int, str]] = []
        if "email" in spots:
            found += self._emails(t, spots["email"])
        if "digit" in spots:
            # the first digit of each run
            runs = [p for p in spots["digit"] if not (p and t[p - 1] in DIGITS)]
            if "id" in spots:
                found += self._ids(t, low, spots["id"])
            found += self._bare_ids(t, low, runs)
            found += self._addresses(t, spots)
            found += self._phones(t, low, runs, self._mask(t, found))
        if "name" in spots:
            found += self._names(t, low, spots["name"], self._mask(t, found))
        rank = {k: i for i, k in enumerate(KINDS)}
        found.sort(key=lambda x: (-(x[1] - x[0]), rank[x[2]], x[0]))
        kept: list[tuple[int, int, str]] = []
        taken = bytearray(len(t))
        for a, b, k in found:
            if 1 not in taken[a:b]:
                taken[a:b] = b"\x01" * (b - a)
                kept.append((a, b, k))
        kept.sort()
        if at is None:
            return [(k, a, b) for a, b, k in kept]
        out = []
        for a, b, k in kept:
            end = at[b - 1] + 1
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1
            out.append((k, at[a], end))
        return out

    @staticmethod
    def _mask(t: str, found: list[tuple[int, int, str]]) -> bytearray:
        out = bytearray(len(t))
        for a, b, _ in found:
            out[a:b] = b"\x01" * (b - a)
        return out

    # parsers: each expands an anchor in the folded text

    def _emails(self, t: str, spots: list[int]) -> list[tuple[int, int, str]]:
        out = []
        done = 0
        for p in spots:
            if p < done:
                continue
            a = p - (p > 0 and t[p] != " " and t[p - 1].isspace())
            while a > done and t[a - 1] in LOCAL:
                a -= 1
            m = EMAIL.match(t, a)
            if m and m.end() > p:
                out.append((a, m.end(), "email"))
                done = m.end()
        return out

    def _id_value(self, t: str, start: int, stop: int) -> tuple[int, int] | None:
        for m in ID_VALUE.finditer(t, start, stop):
            v = m[0]
            # a capital word before the digits is no part of the number
            lead = re.match(r"(?:(?:[A-Z]{3,}|ID|NO|NR|IS) )+", v)
            a = m.start() + (lead.end() if lead else 0)
            v = t[a : m.end()]
            core = re.sub(r"[^A-Z0-9]", "", v)
            if sum(c.isdigit() for c in core) < 5 or not 6 <= len(core) <= 20:
                continue
            if a and (t[a - 1].isalnum() and t[a - 1] < "\x80"):
                continue
            if m.end() < len(t) and t[m.end()].isalnum() and t[m.end()] < "\x80":
                # a following word was cut at its capital: drop the last group
                cut = max(v.rfind(" "), v.rfind("-"))
                if cut < 0:
                    continue
                v = v[:cut]
            v = re.sub(r"(?:[ .\-/][A-Z])+$", lambda x: x[0] if re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} [A-Z]", v) else "", v)
            return a, a + len(v.rstrip(" .-/"))
        return None

    def _ids(self, t: str, low: str, spots: list[int]) -> list[tuple[int, int, str]]:
        """A cue reaches to the next cue or to the end of its line or sentence."""
        out = []
        ends = [m.start() for m in SENTENCE_END.finditer(t)]
        spots = sorted(set(spots))
        for p, following in zip(spots, [*spots[1:], len(t)], strict=True):
            k = bisect_left(ends, p)
            hit = self._id_value(t, p, min(following, ends[k] if k < len(ends) else len(t)))
            if hit and not NOT_PERSONAL.search(low[max(p, hit[0] - CUE_LENGTH) : hit[0]]):
                out.append((*hit, "id_number"))
        return out

    def _bare_ids(self, t: str, low: str, runs: list[int]) -> list[tuple[int, int, str]]:
        """Numbers whose form alone tells: two letters before the digits, or three groups."""
        out = []
        for p in runs:
            for m in (ID_FORMS[0].match(t, max(0, p - 3)), ID_FORMS[0].match(t, max(0, p - 2)), ID_FORMS[1].match(t, p)):
                if m and m.start() <= p < m.end() and not NOT_PERSONAL.search(phrase_before(low, m.start())):
                    out.append((m.start(), m.end(), "id_number"))
                    break
        return out

    def _addresses(self, t: str, spots: dict[str, list[int]]) -> list[tuple[int, int, str]]:
        """Addresses around street words; the parser of a language reads each line that holds one of its words once."""
        out = []
        for kind, rx in (("en", EN_ADDRESS), ("de", DE_ADDRESS), ("fr", FR_ADDRESS), ("es", ES_ADDRESS), ("ja", JA_ADDRESS), ("zh", ZH_ADDRESS)):
            places = sorted(set(spots.get(kind, ())))
            read = -1
            for p in places:
                if p < read:
                    continue
                line = t.rfind("\n", 0, p) + 1 if p else 0
                read = t.find("\n", p) + 1 or len(t) + 1
                for m in rx.finditer(t, line, read - 1):
                    a, b = m.start(), m.end()
                    k = bisect_left(places, a - 3)
                    if k == len(places) or places[k] >= b:
                        continue
                    if kind in ("ja", "zh"):
                        lead = LEAD.match(t[a : a + max(0, t[a:b].find("市"))])
                        if lead:
                            a += lead.end()
                        b = a + len(t[a:b].rstrip("-"))
                    if kind == "de" and DE_TIME.match(t, a, b):
                        continue
                    if kind == "en":
                        b = self._trim_town(t, m)
                    out.append((a, b, "address"))
        return out

    @staticmethod
    def _trim_town(t: str, m: re.Match) -> int:
        """A town is one or more capitalised words; words after the first that open a new sentence do not belong to it."""
        if m["town"] and not m["code"] and " " in m["town"]:
            return m.start("town") + m["town"].index(" ")
        return m.end()

    def _phones(self, t: str, low: str, runs: list[int], taken: bytearray) -> list[tuple[int, int, str]]:
        out = []
        done = 0
        for p in runs:
            if p < done:
                continue
            # the sign and the bracket before the first digit belong to the number
            starts = [p - k for k in (2, 1) if p >= k and set(t[p - k : p]) <= set("+(")] + [p]
            m = next((m for x in starts if x >= done and (m := PHONE.match(t, x))), None)
            if m is None:
                continue
            done = m.end()
            a, b = m.start(), m.end()
            v = m[0]
            if v.startswith("(") and ")" not in v:
                a += 1
                v = v[1:]
            if 1 in taken[a:b]:
                continue
            digits = re.sub(r"\D", "", v)
            if not 7 <= len(digits) <= 15:
                continue
            before = phrase_before(low, a)
            if NOT_PERSONAL.search(before):
                continue
            if b < len(t) and re.match(r"-?[A-Za-z]", t[b : b + 2]) and t[b : b + 1] < "\x80":
                continue
            if re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}", v):
                continue
            if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", v) or re.fullmatch(r"\d{1,3}(?:[ .]\d{3})+(?:\.\d{2})?", v) and not v.startswith("0"):
                continue
            if re.match(r"[.,]\d{2}\b", t[b : b + 3]) and not v.startswith(("+", "0", "(")):
                continue
            cue = CALL_CUES.search(before) is not None
            ok = (
                v.startswith("+") and len(digits) >= 8
                or v.startswith("00") and len(digits) >= 10
                or re.fullmatch(r"\(?[1-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}", v) is not None
                or v.lstrip("(").startswith("0") and 9 <= len(digits) <= 12
                or re.fullmatch(r"1[3-9]\d[ -]?\d{4}[ -]?\d{4}", v) is not None and cue
                or cue and len(digits) >= 7 and not v.isdigit()
                or cue and v.isdigit() and 8 <= len(digits) <= 13
            )
            if ok:
                out.append((a, b, "phone"))
        return out

    def _names(self, t: str, low: str, spots: list[int], taken: bytearray) -> list[tuple[int, int, str]]:
        out = []
        done = -1
        model = self.model
        for p in sorted(set(spots)):
            if p < done:
                continue
            if not t[p].isupper():
                if not t[p].islower() and (hit := self._caseless(t, low, p)) and 1 not in taken[p : hit]:
                    done = hit
                    if not NOT_PERSON_AFTER.match(low, hit):
                        out.append((p, hit, "name"))
                continue
            if p and letter(t[p - 1]):
                continue
            e = p
            while e < len(t) and letter(t[e]):
                e += 1
            word = t[p:e]
            kinds = model.kinds(word)
            if not kinds or 1 in taken[p:e]:
                continue
            a, b, full = self._expand(t, p, e, kinds)
            done = max(b, e)
            if full is None:
                continue
            if NOT_PERSON_AFTER.match(low, b):
                continue
            out.append((a, b, "name"))
        return out

    def _listed(self, low: str, p: int) -> int:
        """End of the longest listed part at ``p``, or ``p``."""
        return next((p + n for n in range(min(self.longest, len(low) - p), 0, -1) if low[p : p + n] in self.model.listed), p)

    def _caseless(self, t: str, low: str, p: int) -> int:
        """End of a name in a script without capitals, or 0: listed parts side by side, or one with an honorific behind or a cue before it."""
        spaced = letter(t[p])
        if spaced and p and letter(t[p - 1]):
            return 0
        e = self._listed(low, p)
        if e == p or spaced and e < len(t) and letter(t[e]):
            return 0
        parts = 1
        while True:
            q = e + (e < len(t) and t[e] in " ・·")
            f = self._listed(low, q) if q > e or not spaced else q
            if f == q or t[q].isupper() or t[q].islower() or letter(t[q]) and f < len(t) and letter(t[f]):
                break
            e, parts = f, parts + 1
        if parts > 1 and (e - p > 2 or self.model.listed[low[p]] != self.model.listed[low[e - 1]]) or HONORIFIC.match(t, e):
            return e
        return e if e - p > 1 and NAME_CUES.search(phrase_before(low, p)) else 0

    def _word_kinds(self, w: str) -> set[str]:
        return self.model.kinds(w) if w[:1].isupper() else set()

    def _expand(self, t: str, p: int, e: int, kinds: set[str]) -> tuple[int, int, str | None]:
        """Grows a name part to the whole name; the third value is None when it names no person."""
        word = t[p:e]
        before = words_before(t, p)
        a, b = p, e
        if word.isupper() and "family" in kinds:
            m = GIVEN_AFTER.match(t, e)
            if m and "given" in self._word_kinds(m[1]):
                return a, m.end(), "family first"
        if "given" in kinds:
            m = FAMILY_AFTER.match(t, e)
            if m:
                if any("family" in self.model.kinds(w) for w in re.findall(rf"{CAP}|{UP}", m[1])):
                    return a, m.end(), "given family"
                if PARTICLE_AFTER.match(t, e):
                    return a, m.end(), "given particle"
                if INITIALS_AFTER.match(t, e) and NAME_CUES.search(plain(before)[0].lower()):
                    return a, m.end(), "given initial"
            m = INITIAL_END.match(t, e)
            if m:
                return a, m.end(), "given initial"
            if "family" not in kinds or not re.search(rf"(?:[{CAPITALS}]\. )$", before):
                tail = DOUBLE_AFTER.match(t, e)
                if tail:
                    return a, tail.end(), "double given"
                if kinds == {"given"} or NAME_CUES.search(before.lower()):
                    return a, b, "given"
        if "family" in kinds:
            tail = JOINED_AFTER.match(t, e)
            if tail:
                b = tail.end()
            m = INITIALS_BEFORE.search(before)
            if m:
                return p - (len(before) - m.start()), b, "initial family"
            m = GIVEN_BEFORE.search(before)
            if m and m[1].lower() not in TITLES and (self._word_kinds(m[1]) or m[2]) and not NOT_PERSON_BEFORE.search(m[0].lower()):
                return p - (len(before) - m.start()), b, "given family"
            m = CUED_BEFORE.search(before)
            if m and m[1].lower() not in TITLES and NAME_CUES.search(before[: m.start()].lower()):
                return p - (len(before) - m.start()), b, "unlisted given"
            if TITLE_BEFORE.search(before) or HONORIFIC.match(t, b):
                return a, b, "titled"
        return a, b, None


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by the placeholder of its kind."""
    if text is None:
        return None
    out: list[str] = []
    at = 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
