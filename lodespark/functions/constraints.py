"""Boolean constraints on texts: ``(mouse OR rat) AND decision making NOT "visual cortex"`` as one column predicate.

NOT binds closest, then AND, then OR; parentheses group; words next to each other are one phrase, quoted or not; a NOT
after a term excludes (AND NOT). The predicate is plain comparisons, so Catalyst can move it to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(r'"([^"]+)"|([()])|([^\s()"]+)')
#: Terms of the field and the modality that each implies.
IMPLIED = {
    "neuropixels": "ephys", "patch clamp": "ephys", "two-photon": "calcium_imaging", "widefield": "calcium_imaging", "bold": "fmri", "eeg": "eeg", "meg": "meg",
}


@dataclass(frozen=True)
class Node:
    """An operator (and, or, not) over nodes, or a term."""

    kind: str
    parts: tuple[Node, ...] = ()
    term: str = ""


@dataclass
class Terms:
    """What a query asks for and excludes, without its structure."""

    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    implied: list[str] = field(default_factory=list)

    @property
    def semantic_query(self) -> str:
        return " ".join(self.positive)


def _tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text): and, or, not, (, ), or a word or quoted phrase as term."""
    out = []
    for quoted, bracket, word in _TOKEN.findall(query):
        kind = bracket or (word.lower() if word.upper() in ("AND", "OR", "NOT") else "term")
        out.append((kind, quoted or word))
    return out


def split_terms(query: str, imply: bool = True) -> Terms:
    """Words and quoted phrases of a query: what directly follows a NOT is excluded, all other terms are asked for.

    With ``imply`` terms that imply a modality add it. Brackets are no structure here.
    """
    found, negate = Terms(), False
    for kind, text in _tokens(query):
        if kind == "not":
            negate = True
        elif kind == "term":
            (found.negative if negate else found.positive).append(text)
            negate = False
        elif kind in ("and", "or"):
            negate = False
    if imply:
        found.implied = [IMPLIED[t.lower()] for t in found.positive if t.lower() in IMPLIED]
    return found


def tree(query: str) -> Node | None:
    """The query's constraint tree; None if it has no term. Operators without an operand and brackets without a partner are ignored."""
    tokens, at = _tokens(query), 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def joined(kind: str, parts: list[Node]) -> Node | None:
        return parts[0] if len(parts) == 1 else Node(kind, tuple(parts)) if parts else None

    def either() -> Node | None:
        nonlocal at
        parts = [x for x in [both()] if x]
        while peek() == "or":
            at += 1
            parts += [x for x in [both()] if x]
        return joined("or", parts)

    def both() -> Node | None:
        nonlocal at
        parts = [x for x in [one()] if x]
        while peek() in ("and", "not", "(", "term"):
            at += peek() == "and"
            parts += [x for x in [one()] if x]
        return joined("and", parts)

    def one() -> Node | None:
        nonlocal at
        kind = peek()
        if kind == "not":
            at += 1
            inner = one()
            return inner and Node("not", (inner,))
        if kind == "(":
            at += 1
            inner = either()
            at += peek() == ")"
            return inner
        words = []
        while peek() == "term":
            words.append(tokens[at][1])
            at += 1
        return Node("term", term=" ".join(words)) if words else None

    found = []
    while at < len(tokens):
        if node := either():
            found.append(node)
        if at < len(tokens):  # an operator or bracket that nothing has taken
            at += 1
    return joined("and", found)


def predicate(node: Node, columns: list[Column], case_sensitive: bool = False) -> Column:
    """Whether a row meets the tree: a term is met if any of the columns contains it. Null columns contain nothing.

    Never null if letters' case is ignored; with ``case_sensitive`` null may stand for false, and the whole predicate reaches the scan.
    """

    def met(n: Node) -> Column:
        if n.kind == "term":
            term = n.term if case_sensitive else n.term.lower()
            hits = [(c if case_sensitive else F.lower(c)).contains(term) for c in columns]
            return reduce(Column.__or__, [F.coalesce(h, F.lit(False)) for h in hits])
        if n.kind == "not":
            return ~met(n.parts[0])
        return reduce(Column.__and__ if n.kind == "and" else Column.__or__, map(met, n.parts))

    def bare(n: Node, wanted: bool = True) -> Column:
        """The same in a form that scans understand: negation stands at the terms, where nulls are asked for by name."""
        if n.kind == "term":
            hits = [c.contains(n.term) if wanted else c.isNull() | ~c.contains(n.term) for c in columns]
            return reduce(Column.__or__ if wanted else Column.__and__, hits)
        if n.kind == "not":
            return bare(n.parts[0], not wanted)
        return reduce(Column.__and__ if (n.kind == "and") == wanted else Column.__or__, [bare(x, wanted) for x in n.parts])

    return F.coalesce(met(node), F.lit(False)) if not case_sensitive else bare(node)
