"""One document through extraction, normalisation, scans and structure rules."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from glyphloom import policy
from glyphloom.functions.chars import byte_table
from glyphloom.functions.document import HEADING, QUOTED, Doc
from glyphloom.functions.fidelity import carries
from glyphloom.functions.guards import MAX_BYTES, looks_like_source, prepare
from glyphloom.functions.markdown import read_markdown, read_text
from glyphloom.functions.normview import NormView, build
from glyphloom.functions.scan import Engine, Hit
from glyphloom.functions.structure_rules import Structure

SNIPPET = 200
MAX_FINDINGS = 10_000
#: The relations that a caller may ask for; what is not asked for is not computed.
RELATIONS = ("hits", "segments", "sections")


@dataclass(frozen=True)
class Settings:
    """What a reading depends on besides the document."""

    max_bytes: int = MAX_BYTES
    max_findings: int = MAX_FINDINGS
    license_wording: str | None = None
    markers: tuple[str, ...] = ()
    product_names: tuple[str, ...] = ()


@lru_cache(maxsize=64)
def _structure(profile: str, license_wording: str | None = None, markers: tuple[str, ...] = (), product_names: tuple[str, ...] = ()) -> Structure:
    return Structure(Engine(profile), license_wording, markers, product_names)


def read(text: str, input_format: str) -> Doc:
    return read_text(text) if input_format == "text" else read_markdown(text)


def find_hits(doc: Doc, norm: NormView, profile: str, settings: Settings = Settings(), mixed: bool = False, bom: bool = False) -> list[Hit]:
    s = _structure(profile, settings.license_wording, settings.markers, settings.product_names)
    return s.run(doc, norm, s.e.scan(doc, norm), mixed, bom)


class Places:
    """What holds a place of a document, looked up in tables sorted by their starts."""

    def __init__(self, doc: Doc, norm: NormView):
        self.norm = norm
        self.headings = sorted((h.start, h.end) for h in doc.headings)
        self.code = sorted((s, e) for s, e, _, _ in doc.code)
        self.sections = sorted((s, level, title) for title, level, s, _ in doc.sections)

    def container(self, h: Hit) -> str:
        k = bisect_right(self.headings, (h.start, float("inf"))) - 1
        if k >= 0 and h.start < self.headings[k][1]:
            return "heading"
        k = bisect_right(self.code, (h.start, float("inf"))) - 1
        if k >= 0 and h.end <= self.code[k][1]:
            return "fenced-code"
        k = self.norm.at_source(h.start)
        if k is not None:
            if self.norm.has(k, QUOTED):
                return "blockquote"
            if self.norm.has(k, HEADING):
                return "heading"
        return "prose"

    def section(self, at: int) -> str | None:
        """Title of the deepest section around a place: that of the last heading before it."""
        k = bisect_right(self.sections, (at, 7, "")) - 1
        return self.sections[k][2] if k >= 0 else None


def analyze_bytes(raw: bytes, profile: str, input_format: str = "markdown", settings: Settings = Settings(), want: tuple[str, ...] = RELATIONS) -> dict:
    """Everything the relational stages need about one document; byte offsets of the payload.

    A document with more findings than the limit, or with a finding whose source slice does not carry what
    matched, fails closed: status ``instrumentation_error`` without hits; its coverage stays.
    """
    p = prepare(raw, settings.max_bytes)
    row = {
        "sha256": p.sha256, "bytes": p.size, "bom_stripped": p.bom, "mixed_line_endings": p.mixed, "status": "ok", "error": p.error,
        "word_count": 0, "byte_len": 0, "prose_bytes": 0, "bullets": 0, "linked_bullets": 0, "task_bullets": 0, "paragraph_words": [],
        "hits": [], "segments": [], "sections": [],
    }
    if p.error:
        row["status"] = "unsupported_input"
        return row
    doc = read(p.text, input_format)
    trouble = looks_like_source(p.text, [(s, e) for s, e, k in doc.regions if k == "code_fence"])
    if trouble:
        row |= {"status": "unsupported_input", "error": trouble}
        return row
    table = byte_table(p.text)
    off = (lambda i: i) if table is None else (lambda i: int(table[i]))
    row |= {
        "word_count": doc.words, "byte_len": off(len(p.text)), "bullets": doc.bullets, "linked_bullets": doc.linked_bullets,
        "task_bullets": doc.task_bullets, "paragraph_words": doc.paragraph_words,
        "prose_bytes": sum(off(e) - off(s) for s, e, k in doc.regions if k == "prose"),
    }
    if "segments" in want:
        row["segments"] = [{"start": off(s), "end": off(e), "reason": k} for s, e, k in doc.regions]
    if "sections" in want:
        row["sections"] = [{"title": t, "level": lv, "start": off(s), "end": off(e)} for t, lv, s, e in doc.sections]
    if "hits" not in want:
        return row
    norm = build(doc)
    hits = find_hits(doc, norm, profile, settings, p.mixed, p.bom)
    hits = [h for h in hits if not (h.quoted and h.rule in policy.QUOTE_SUPPRESS)]
    if len(hits) > settings.max_findings:
        row |= {"status": "instrumentation_error", "error": f"findings exceed the {settings.max_findings} limit"}
        return row
    lost = next((h for h in hits if not carries(doc, norm, h)), None)
    if lost is not None:
        row |= {"status": "instrumentation_error", "error": f"{lost.rule}: source bytes {off(lost.start)}..{off(lost.end)} do not carry what matched"}
        return row
    places = Places(doc, norm)
    for i, h in enumerate(hits):
        text = p.text[h.start : h.end]
        row["hits"].append({
            "seq": i, "rule_id": h.rule, "start": off(h.start), "end": off(h.end), "quoted": h.quoted, "force_candidate": h.force_candidate,
            "force_hint": h.force_hint, "detail": h.detail, "matched": text, "snippet": text[:SNIPPET].encode()[:SNIPPET].decode(errors="ignore"),
            "container": places.container(h), "section": places.section(h.start),
        })
    return row


def lint(text: str, profile: str = "general-writing", input_format: str = "markdown") -> list[str]:
    """Rule ids found in a text, in source order (a convenience for tests and notebooks)."""
    row = analyze_bytes(text.encode(), profile, input_format)
    return [h["rule_id"] for h in sorted(row["hits"], key=lambda h: (h["start"], h["end"], h["rule_id"]))]
