"""Checks that a reported source slice still carries the text that matched."""

from __future__ import annotations

import re
import unicodedata

from glyphloom.functions.chars import ENTITIES, INVISIBLE, NUMERIC_REF, lower_ascii, numeric_ref
from glyphloom.functions.document import Doc
from glyphloom.functions.normview import NormView, _folds
from glyphloom.functions.chars import ALNUM_RUN
from glyphloom.functions.scan import Hit

_ENTITY = re.compile("|".join(map(re.escape, ENTITIES)))
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)


def render_key(s: str) -> str:
    """A comparable form: references decoded, escapes resolved, tags and invisible characters out, folded, one space, lower case."""
    s = _ENTITY.sub(lambda m: ENTITIES[m[0]], s)
    s = NUMERIC_REF.sub(lambda m: numeric_ref(s, m.start())[2] or "\ufffd", s)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s)
    s = INVISIBLE.sub("", _TAG.sub("", s))
    s = unicodedata.normalize("NFC", s)

    def fold(m) -> str:
        f = None if m[0].isascii() else _folds(m[0])
        return m[0] if f is None else "".join(c if to is None else to for c, to in zip(m[0], f[0]))

    return lower_ascii(" ".join(ALNUM_RUN.sub(fold, s).split()))


def carries(doc: Doc, norm: NormView, h: Hit) -> bool:
    """Whether the slice, the view over it, or a decoded link destination holds the trigger."""
    if not h.trigger or h.trigger in doc.text[h.start : h.end]:
        return True
    want = render_key(h.trigger)
    if not want or want in render_key(doc.text[h.start : h.end]) or want in render_key(norm.from_source(h.start, h.end)):
        return True
    return any(h.trigger in text for s, e, text in doc.decoded if s <= h.start and h.end <= e)
