"""Mixing sources to target weights (problem 7): budgets over a domain-source-language tree and seeded epochs.

Budgets flow from the root to the leaves by weight; what a node cannot use within its
repeat cap goes to its siblings first and to its parent's siblings only when they are
full.  A leaf takes whole seeded epochs and then a token-prefix of one more epoch.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass, field

TOKENIZER = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
#: Parameter that belongs to the tokenizer: how it splits a text before it joins bytes.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Node:
    name: str
    weight: float
    size: int = 0
    cap: int = 1
    children: list["Node"] = field(default_factory=list)
    budget: float = 0.0

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children) if self.children else float(self.size * self.cap)


def share_out(node: Node, budget: float) -> float:
    """Assigns ``budget`` to a subtree by weight; returns what does not fit.  Shortages go round among siblings first."""
    node.budget = min(budget, node.capacity)
    if not node.children:
        return budget - node.budget
    left = node.budget
    given = dict.fromkeys(range(len(node.children)), 0.0)
    open_ = [i for i, c in enumerate(node.children) if c.capacity > 0]
    while left > 1e-6 and open_:
        total = sum(node.children[i].weight for i in open_)
        parts = {i: (node.children[i].weight / total if total > 0 else 1 / len(open_)) * left for i in open_}
        left = 0.0
        for i, p in parts.items():
            room = node.children[i].capacity - given[i]
            used = min(p, room)
            given[i] += used
            left += p - used
        open_ = [i for i in open_ if node.children[i].capacity - given[i] > 1e-6]
    for i, c in enumerate(node.children):
        share_out(c, given[i])
    return budget - node.budget


def build_tree(targets: list[tuple[str, float, int]], leaves: dict[tuple[str, str], int], domains: dict[str, str]) -> Node:
    """Root, domains, sources, languages; domain and source weights from the targets, language weights from sizes."""
    root = Node("", 1.0)
    by_domain: dict[str, Node] = {}
    for source, share, cap in targets:
        domain = by_domain.get(d := domains.get(source, source))
        if domain is None:
            domain = by_domain[d] = Node(d, 0.0)
            root.children.append(domain)
        domain.weight += share
        node = Node(source, share, cap=cap)
        langs = sorted((lang, n) for (s, lang), n in leaves.items() if s == source)
        node.children = [Node(lang, float(n), n, cap) for lang, n in langs]
        if not node.children:
            node.size = 0
        domain.children.append(node)
    return root


def feasible_total(targets: list[tuple[str, float, int]], leaves: dict[tuple[str, str], int]) -> float:
    """The largest total at which every source that has records reaches its share within its cap.

    A source without records cannot reach anything; its share is spread, so it does not bind.
    """
    sizes: dict[str, int] = {}
    for (s, _), n in leaves.items():
        sizes[s] = sizes.get(s, 0) + n
    alive = sum(share for s, share, _ in targets if sizes.get(s) and share > 0)
    bounds = [sizes[s] * cap * alive / share for s, share, cap in targets if sizes.get(s) and share > 0]
    return min(bounds, default=0.0)


def leaf_plans(root: Node) -> list[tuple[str, str, int, int]]:
    """(source, language, whole epochs, tokens of the last, partial epoch)."""
    out = []
    for domain in root.children:
        for source in domain.children:
            for leaf in source.children:
                if leaf.size <= 0:
                    continue
                whole = min(int(leaf.budget // leaf.size), leaf.cap)
                rest = 0 if whole >= leaf.cap else int(math.floor(leaf.budget - whole * leaf.size + 0.5))
                out.append((source.name, leaf.name, whole, rest))
    return out


_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str = SPLIT_PATTERN):
    """A tiktoken encoder from a public rank file and its split pattern (parameters; nothing is trained or copied)."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        name = hashlib.md5(f"{path} {pattern}".encode()).hexdigest()
        _encoders[path, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]
