"""The rule package: declarative rules as data, loaded once a process."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

PROFILES = ("general-writing", "blog-post", "email", "report", "doc", "social-post", "comment")
FORMATS = ("markdown", "text")
VERSION = "1"
#: Rules whose quoted violations drop to candidate, and rules whose quoted hits are dropped.
QUOTE_DOWNGRADE = ("M001", "M002", "M003", "M006", "A001", "A002", "T001", "I001", "I002", "O003")
QUOTE_SUPPRESS = ("A005",)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    family: str
    tier: str
    lifecycle: str
    view: str
    kind: str
    terms: tuple[str, ...] = ()
    swaps: dict[str, str] = field(default_factory=dict)
    patterns: tuple[str, ...] = ()
    case_sensitive: bool = False
    word_boundary: bool = False
    block_start: bool = False
    scope: str = "none"
    human_only: bool = False
    stances: dict[str, str] = field(default_factory=dict)
    exempt: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)

    def stance(self, profile: str) -> str:
        return self.stances.get(profile, self.stances.get("default", "apply"))


def _read(name: str) -> tuple[dict, str]:
    text = resources.files(__package__).joinpath(f"{name}.toml").read_text(encoding="utf-8")
    return tomllib.loads(text), text


@lru_cache(maxsize=1)
def rules() -> dict[str, Rule]:
    """All rules by id, in declaration order; raises ``ValueError`` on a malformed package."""
    table, _ = _read("rules")
    terms, _ = _read("terms")
    patterns, _ = _read("patterns")
    out: dict[str, Rule] = {}
    for rid, r in table.items():
        words, swaps = [], {}
        for line in terms.get(rid, ()):
            word, arrow, plain = line.partition(" -> ")
            words.append(word.lower() if r.get("case") != "sensitive" else word)
            if arrow:
                swaps[word.lower()] = plain
        if r["tier"] not in ("violation", "candidate", "coverage_hint"):
            raise ValueError(f"{rid}: unknown tier {r['tier']}")
        unknown = set(r["stances"]) - {"default", *PROFILES}
        if unknown or set(r["stances"].values()) - {"apply", "relax", "off"}:
            raise ValueError(f"{rid}: bad stances {r['stances']}")
        for p in patterns.get(rid, ()):
            check_bounded(rid, p)
        out[rid] = Rule(
            id=rid, name=r["name"], family=r["family"], tier=r["tier"], lifecycle=r["lifecycle"], view=r["view"], kind=r["kind"],
            terms=tuple(words), swaps=swaps, patterns=tuple(patterns.get(rid, ())), case_sensitive=r.get("case") == "sensitive",
            word_boundary=r.get("boundary") == "word", block_start=r.get("position") == "block-start", scope=r.get("scope", "none"),
            human_only=r.get("waiver") == "human-only", stances=r["stances"],
            exempt=tuple(p for ps in r.get("exempt", {}).values() for p in ps), params=r.get("params", {}),
        )
    return out


def check_bounded(rule_id: str, pattern: str) -> None:
    """Every repetition must be bounded, so that no pattern runs away on long input."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    if re.search(r"(?<!\()[*+]|\{\d+,\}", bare):
        raise ValueError(f"{rule_id}: unbounded repetition in {pattern}")


def digest() -> str:
    """sha256 over the three data files with even line ends, in name order."""
    h = hashlib.sha256()
    for name in ("patterns", "rules", "terms"):
        h.update(name.encode() + b"\0" + _read(name)[1].replace("\r\n", "\n").encode() + b"\0")
    return h.hexdigest()


def show() -> str:
    """The rule listing as JSON."""
    return json.dumps([{"id": r.id, "name": r.name, "family": r.family, "tier": r.tier, "lifecycle": r.lifecycle} for r in rules().values()])


def snapshot() -> str:
    """The rule listing as a Markdown reference, by family."""
    lines = [f"# Rules ({digest()[:12]})", ""]
    family = None
    for r in rules().values():
        if r.family != family:
            family = r.family
            lines += [f"## {family}", ""]
        off = ", ".join(f"{p} {r.stance(p)}" for p in PROFILES if r.stance(p) != "apply") or "all apply"
        lines.append(f"- **{r.id} {r.name}** ({r.tier}, {r.lifecycle}; {off})")
        if r.terms:
            lines.append(f"  - words: {', '.join(r.terms)}")
    return "\n".join([*lines, ""])


def rules_rows() -> list[tuple]:
    return [(r.id, r.name, r.family, r.tier, r.lifecycle, r.view, r.kind, r.human_only) for r in rules().values()]


def stance_rows() -> list[tuple]:
    return [(r.id, p, r.stance(p)) for r in rules().values() for p in PROFILES]
