"""A readable report of one document."""

from __future__ import annotations

from glyphloom.operators.analysis import Analysis


def escape(s: str) -> str:
    """Control characters as upper-case escapes, so that a report cannot steer a terminal."""
    return "".join(f"\\u{ord(c):04X}" if ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 else c for c in s)


def render(a: Analysis, doc_id: int) -> str:
    """Findings, hints, rates, coverage and notes of one document (its rows only are collected)."""
    one = lambda df: df.where(df["doc_id"] == doc_id).collect()
    docs = one(a.documents)
    if not docs:
        return f"document {doc_id}: not found\n"
    d = docs[0]
    lines = [f"document {doc_id} ({d['profile']}): {d['result_state']}", ""]
    if d["error"]:
        lines += [d["error"], ""]
    found = sorted(one(a.findings), key=lambda r: (r["start"], r["end"], r["rule_id"]))
    for title, hint in (("findings", False), ("hints", True)):
        rows = [r for r in found if (r["state"] == "coverage_hint") == hint]
        if rows:
            lines.append(f"{title}:")
            for r in rows:
                waived = " waived" if r["waived"] else ""
                fix = "" if r["replace_with"] is None else f" -> {escape(r['replace_with'])!r}"
                lines.append(f"  {r['start']}..{r['end']} {r['rule_id']} {r['state']}/{r['lifecycle']}{waived} {r['message']}: {escape(r['snippet'])}{fix}")
            lines.append("")
    rates = sorted(one(a.families), key=lambda r: r["family"])
    lines += ["rates per 1000 words:", *(f"  {r['family']} {r['findings']} ({r['per_1000_words']})" for r in rates), ""] if rates else []
    lines.append(f"coverage: {d['prose_bytes']} of {d['byte_len']} bytes are prose, {d['word_count']} words")
    lines += [f"note: {n}" for n in d["notes"]]
    return "\n".join(lines) + "\n"
