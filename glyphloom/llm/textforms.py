"""One consistent form for texts that look alike (problem 5), as SQL that DuckDB runs inside Arrow partitions.

The same tables give a Python ``fold`` for the other operators of this subpackage.
Order: line ends, invisible characters out, compatibility forms and spaces, look-alike
letters to Latin, ligatures, canonical composition (NFC).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa

# Characters without a visible shape.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069\u206a"
    "\u206b\u206c\u206d\u206e\u206f\u3164\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09"
    "\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff\uffa0"
)
# Letters of other scripts with the shape of a Latin letter.
CYRILLIC = "аеосрухіѕјԁԛԝһӏ" + "АВЕКМНОРСТХУІЅЈԚԜҺӀ"
CYRILLIC_TO = "aeocpyxisjdqwhl" + "ABEKMHOPCTXYISJQWHI"
GREEK = "οѵαρνικυγχϲϳ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ"
GREEK_TO = "ovapvikuyxcj" + "ABEZHIKMNOPTYXCJ"
ARMENIAN = "օսհոՕՍԼԱ"
ARMENIAN_TO = "ouhnOULU"
# Greek and Armenian lower-case letters below look only roughly alike and are left alone.
ROUGH = set("αγινκυρχ" + ARMENIAN) - {"օ", "Օ"}
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\u2043"
MARKS = {"\u2032": "'", "\u02bc": "'", "\uff07": "'", "\ufe52": ".", "\u2024": ".", "\u2044": "/", "\u2215": "/",
         "\u2236": ":", "\u02d0": ":", "\x85": "\n", "\uff9e": "\u3099", "\uff9f": "\u309a", "\u212b": "\u00c5",
         "\u2126": "\u03a9", "\u037e": ";", "\u0387": "\u00b7"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": "..",
             "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ĳ": "ij", "Ĳ": "IJ", "‼": "!!", "⁇": "??", "⁈": "?!", "⁉": "!?"}


# Blocks of compatibility characters with the shape of ordinary ones: width variants, letter-like and
# styled letters, numerals, squared units, Arabic presentation forms.
FORM_BLOCKS = ((0xFF01, 0xFF9D), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFEE), (0x2100, 0x214F), (0x2160, 0x217F), (0x2460, 0x24FF), (0x3371, 0x33DF), (0xFB50, 0xFDFB), (0xFE80, 0xFEFC), (0x1D400, 0x1D7FF))


def ordinary(c: str) -> str:
    """The ordinary form of a compatibility character: one step for width variants (half-width Hangul stays a letter of its own), else NFKC."""
    kind, _, codes = unicodedata.decomposition(c).partition(" ")
    if kind in ("<narrow>", "<wide>"):
        return "".join(chr(int(x, 16)) for x in codes.split())
    return unicodedata.normalize("NFKC", c)


def forms() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility characters whose form is one other character, and those of several letters."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for a, b in FORM_BLOCKS:
        for c in map(chr, range(a, b + 1)):
            k = ordinary(c)
            if len(k) == 1 and k != c:
                one[c] = k
            elif len(k) > 1 and not k[0].isspace() and not (0x2100 <= ord(c) < 0x2160 or 0x2460 <= ord(c) <= 0x24FF):
                more[c] = k
    return one, more


def accented(alike: dict[str, str]) -> dict[str, str]:
    """Composed letters over a look-alike base (Cyrillic yo, Greek omicron with tonos): the Latin letter with the same accent."""
    out: dict[str, str] = {}
    for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0] in alike:
            to = unicodedata.normalize("NFC", alike[base[0]] + base[1:])
            if len(to) == 1:
                out[c] = to
    return out


def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    compat, more = forms()
    compat.update({c: " " for c in SPACES})
    compat.update({c: "-" for c in HYPHENS})
    compat.update(MARKS)
    alike = dict(zip(CYRILLIC + GREEK + ARMENIAN, CYRILLIC_TO + GREEK_TO + ARMENIAN_TO, strict=True))
    alike = {k: v for k, v in alike.items() if k not in ROUGH}
    return compat, alike | accented(alike), {k: v for k, v in (more | LIGATURES).items() if k not in INVISIBLE}


COMPAT, ALIKE, SEVERAL = tables()
COMPAT = {k: v for k, v in COMPAT.items() if k not in INVISIBLE}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RARE = {k: v for k, v in SEVERAL.items() if k not in LIGATURES}
_RARE_CLASS = _quote("[" + "".join(RARE) + "]")


def form_sql(column: str, rare: dict[str, str] = RARE) -> tuple[str, str]:
    """DuckDB expressions (canonical form, skeleton) of a text column; ``rare`` holds the forms of several letters that can occur."""
    e = f"regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10), 'g')"
    e = f"regexp_replace({e}, '[' || {_quote(INVISIBLE)} || ']', '', 'g')"
    e = f"translate({e}, {_quote(''.join(COMPAT))}, {_quote(''.join(COMPAT.values()))})"
    for a, b in LIGATURES.items():
        e = f"replace({e}, {_quote(a)}, {_quote(b)})"
    if rare:
        spelled = "t"
        for a, b in rare.items():
            spelled = f"replace({spelled}, {_quote(a)}, {_quote(b)})"
        # the replacements run only over texts that hold one
        e = f"list_transform([{e}], lambda t: CASE WHEN regexp_matches(t, {_RARE_CLASS}) THEN {spelled} ELSE t END)[1]"
    skeleton = f"translate({e}, {_quote(''.join(ALIKE))}, {_quote(''.join(ALIKE.values()))})"
    trim = "regexp_replace(regexp_replace(nfc_normalize({}), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n+$', '')"
    return trim.format(e), trim.format(skeleton)


_DROP = {ord(c): None for c in INVISIBLE}
_ONE = {**_DROP, **{ord(k): v for k, v in COMPAT.items()}, **{ord(k): v for k, v in SEVERAL.items()}}
# both steps in one: a compatibility form may be a look-alike itself (a styled Greek capital)
_ALL = {**{k: v and "".join(ALIKE.get(c, c) for c in v) for k, v in _ONE.items()}, **{ord(k): v for k, v in ALIKE.items() if ord(k) not in _ONE}}


def fold(text: str) -> str:
    """The skeleton in Python: equal to the SQL form but for line ends and trailing white space."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_ALL))


def canonical(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_ONE))


_connection = None


def duck():
    """One DuckDB connection per Python worker, one thread, bounded memory, no spill to a local folder."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
    return _connection


def key_batches(batches: Iterator[pa.RecordBatch], keep_text: bool, passing: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(prep_id, passing columns, text) batches to (prep_id, passing columns[, canonical_text, skeleton], raw_key, look_key) by embedded SQL."""
    con = duck()
    along = "".join(f'"{c}", ' for c in passing)
    texts = "canon AS canonical_text, skel AS skeleton," if keep_text else ""
    known: dict[tuple[str, ...], str] = {}

    def statement(present: tuple[str, ...]) -> str:
        if present not in known:
            canon, skeleton = form_sql("text", {c: RARE[c] for c in present})
            known[present] = (
                f"SELECT prep_id, {along}{texts} md5(text) AS raw_key, md5(skel) || ':' || length(skel) AS look_key "
                f"FROM (SELECT prep_id, {along}text, {canon if keep_text else 'NULL'} AS canon, {skeleton} AS skel FROM part)"
            )
        return known[present]

    for batch in batches:
        con.register("part", pa.Table.from_batches([batch]))
        try:
            # the statement names only the rare forms that a batch holds: planning all of them would cost more than the batch
            held = con.sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, {_RARE_CLASS})) AS c FROM part WHERE regexp_matches(text, {_RARE_CLASS}) ORDER BY c").fetchall()
            relation = con.sql(statement(tuple(c for c, in held)))
            result = relation.to_arrow_table() if hasattr(relation, "to_arrow_table") else relation.arrow()
        finally:
            con.unregister("part")
        yield from result.to_batches()
