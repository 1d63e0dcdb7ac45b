"""Parsers of query documents and of expansion output."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KINDS = ("lex", "vec", "hyde")


@dataclass(frozen=True)
class SubQuery:
    type: str
    query: str
    line: int | None = None


@dataclass(frozen=True)
class QueryDocument:
    searches: tuple[SubQuery, ...]
    intent: str | None = None


_LINE = re.compile(r"(lex|vec|hyde|intent|expand):\s*(.*)", re.I | re.S)


def parse_query_document(text: str) -> QueryDocument | None:
    """Typed lines of a query document, or None for a plain query that is to be expanded.

    Raises ValueError on mixed, empty, repeated or unprefixed lines.
    """
    lines = [(n, s.strip()) for n, s in enumerate(text.split("\n"), 1) if s.strip()]
    found: list[SubQuery] = []
    intent = None
    for n, line in lines:
        m = _LINE.match(line)
        kind, value = (m.group(1).lower(), m.group(2).strip()) if m else (None, "")
        if kind == "expand":
            if len(lines) > 1:
                raise ValueError(f"line {n}: expand: stands alone, without typed lines")
            if not value:
                raise ValueError("expand: needs a text")
            return None
        if kind is None:
            if len(lines) == 1:
                return None
            raise ValueError(f"line {n} needs one of the prefixes lex:, vec:, hyde: and intent:")
        if not value:
            raise ValueError(f"line {n}: {kind}: needs a text")
        if kind == "intent":
            if intent is not None:
                raise ValueError(f"line {n}: there is already an intent:")
            intent = value
        else:
            if "\r" in value:
                raise ValueError(f"line {n}: {kind}: has a line end within")
            found.append(SubQuery(kind, value, n))
    if intent and not found:
        raise ValueError("intent: needs at least one lex:, vec: or hyde: line beside it")
    return QueryDocument(tuple(found), intent) if found else None


@dataclass
class Expansion:
    queries: list[SubQuery] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)
    message: str = ""

    @property
    def usable(self) -> bool:
        return bool(self.queries)


# What a model repeats from its prompt.
_ECHOES = {"<query>", "</query>", "<intent>", "</intent>", "(keyword or synonym phrase)", "(conceptual or semantic reformulation)", "(hypothetical sentence answering the query)"}
_TYPED = re.compile(r"[-*•\d.\s]*(lex|vec|hyde)\s*:\s*(.+)", re.I)


def parse_expansion(text: str, query: str = "", lexical: bool = True) -> Expansion:
    """Typed lines of a model's output that are about the query, each once; all else is rejected."""
    out = Expansion()
    if not text.strip():
        out.message = "empty output"
        return out
    if "<think>" in text or "</think>" in text:
        out.message = "output has thinking tags"
        return out
    terms = [t for t in re.sub(r"[^a-z0-9\s]", " ", query.lower()).split() if len(t) > 1]
    seen = set()
    for line in filter(None, map(str.strip, text.split("\n"))):
        m = None if line.startswith("```") else _TYPED.fullmatch(line)
        value = m.group(2).strip().strip("\"'`*").strip() if m else ""
        low = value.lower()
        about = not terms or any(t in low for t in terms) or query.lower().strip() in low
        if not value or low in _ECHOES or low.startswith("/no_think") or (query and not about):
            out.rejected.append(line)
            continue
        key = (m.group(1).lower(), value)
        if key not in seen:
            seen.add(key)
            if lexical or key[0] != "lex":
                out.queries.append(SubQuery(*key))
    out.message = "usable" if out.queries else "no valid lines"
    return out


def default_expansion(query: str) -> list[SubQuery]:
    """What is searched for when no model gives a usable expansion."""
    return [SubQuery("lex", query), SubQuery("vec", query), SubQuery("hyde", f"Information about {query}")]
