"""The text query language: parsing, rewriting, printing, and the terms a query asks for.

Operators are looked for in the order boolean, range, field, phrase, fuzzy, wildcard, terms.
A boolean query is split at its first operator, so it leans to the right and has neither
precedence nor parentheses.  ``year:a..b`` is read as a range.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Term:
    text: str
    boost: float = 1.0

    def __str__(self):
        return self.text + _boost(self.boost)


@dataclass(frozen=True)
class Phrase:
    text: str
    slop: int = 0
    boost: float = 1.0

    def __str__(self):
        return f'"{self.text}"' + (f"~{self.slop}" if self.slop else "") + _boost(self.boost)


@dataclass(frozen=True)
class Wildcard:
    pattern: str
    boost: float = 1.0

    def __str__(self):
        return self.pattern + _boost(self.boost)


@dataclass(frozen=True)
class Fuzzy:
    text: str
    edits: int = 2
    boost: float = 1.0

    def __str__(self):
        return f"{self.text}~{self.edits}" + _boost(self.boost)


@dataclass(frozen=True)
class Range:
    field: str
    low: Any
    high: Any
    low_in: bool = True
    high_in: bool = True
    boost: float = 1.0

    def __str__(self):
        show = lambda v: "*" if v is None else str(v)
        return f"{self.field}:{'[' if self.low_in else '{'}{show(self.low)} TO {show(self.high)}{']' if self.high_in else '}'}" + _boost(self.boost)


@dataclass(frozen=True)
class Fielded:
    field: str
    query: Any
    boost: float = 1.0

    def __str__(self):
        return f"{self.field}:{self.query}"


@dataclass(frozen=True)
class Bool:
    op: str  # AND, OR, NOT
    parts: tuple

    def __str__(self):
        if self.op == "NOT":
            return f"NOT {self.parts[0]}" if len(self.parts) == 1 else f"{self.parts[0]} NOT {self.parts[1]}"
        return "(" + f" {self.op} ".join(map(str, self.parts)) + ")"


def _boost(b: float) -> str:
    return "" if b == 1.0 else f"^{b:g}"


BOOST = r"(?:\^(?P<boost>\d+(?:\.\d+)?))?"
RANGE = re.compile(r"^(?P<field>\w+):(?P<open>[\[{])\s*(?P<low>\S+)\s+TO\s+(?P<high>\S+?)\s*(?P<close>[\]}])" + BOOST)
DOTS = re.compile(r"^(?P<field>\w+):(?P<low>\d*|\*)\.\.(?P<high>\d*|\*)$")
FIELD = re.compile(r"^(?P<field>\w+):(?P<rest>.+)$", re.S)
PHRASE = re.compile(r'"(?P<text>[^"]+)"(?:~(?P<slop>\d+))?' + BOOST)
FUZZY = re.compile(r"^(?P<text>\w+)~(?P<n>\d+)?" + BOOST + "$")
WILD = re.compile(r"^(?P<text>[\w*?]*[*?][\w*?]*)" + BOOST + "$")
TERMS = re.compile(r"^(?P<text>.*?)" + BOOST + "$", re.S)


def _number(s: str):
    if s in ("", "*"):
        return None
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _f(m) -> float:
    return float(m["boost"]) if m["boost"] else 1.0


def parse(text: str):
    s = (text or "").strip()
    if not s:
        return Term("")
    m = re.search(r"\b(AND|OR|NOT)\b", s, re.I)
    if m:
        left, right, op = s[: m.start()].strip(), s[m.end() :].strip(), m[1].upper()
        if op == "NOT" and right and not left:
            return Bool("NOT", (parse(right),))
        if left and right:
            return Bool(op, (parse(left), parse(right)))
    if m := RANGE.match(s):
        return Range(m["field"], _number(m["low"]), _number(m["high"]), m["open"] == "[", m["close"] == "]", _f(m))
    if m := DOTS.match(s):
        return Range(m["field"], _number(m["low"]), _number(m["high"]))
    if (m := FIELD.match(s)) and m["field"].lower() not in ("http", "https", "ftp", "file", "mailto"):
        return Fielded(m["field"], parse(m["rest"]))
    if m := PHRASE.search(s):
        return Phrase(m["text"], int(m["slop"] or 0), _f(m))
    if m := FUZZY.match(s):
        return Fuzzy(m["text"], int(m["n"] or 2), _f(m))
    if m := WILD.match(s):
        return Wildcard(m["text"], _f(m))
    m = TERMS.match(s)
    words = m["text"].split()
    if len(words) <= 1:
        return Term(m["text"].strip(), _f(m))
    return Bool("AND", tuple(Term(w, _f(m)) for w in words))


def children(q) -> tuple:
    return q.parts if isinstance(q, Bool) else (q.query,) if isinstance(q, Fielded) else ()


def complexity(q) -> int:
    own = {Term: 1, Wildcard: 3, Fuzzy: 5, Range: 2, Fielded: 1, Bool: 0}.get(type(q), 0)
    return own + (len(q.text.split()) if isinstance(q, Phrase) else 0) + sum(map(complexity, children(q)))


def fields(q) -> list:
    own = [q.field] if isinstance(q, (Fielded, Range)) else []
    return own + [f for c in children(q) for f in fields(c)]


def terms(q) -> list[str]:
    """Words that count in ranking; what is negated does not."""
    if isinstance(q, (Term, Fuzzy)):
        return [q.text] if q.text else []
    if isinstance(q, Phrase):
        return q.text.split()
    if isinstance(q, Bool) and q.op == "NOT":
        return terms(q.parts[0]) if len(q.parts) > 1 else []
    return [t for c in children(q) for t in terms(c)]


def problems(q, known: set[str]) -> list[str]:
    out = [f"unknown field {f}" for f in fields(q) if f not in known]
    if complexity(q) > 50:
        out.append("query is very complex")
    if isinstance(q, Term) and not q.text:
        out.append("query is empty")
    return out


def scaled(q, factor: float):
    """A query with its boost multiplied; boolean and field nodes pass it by."""
    return q if isinstance(q, (Bool, Fielded)) else replace(q, boost=q.boost * factor)


def rewrite(q, change):
    """Applies ``change`` from the leaves up."""
    if isinstance(q, Bool):
        q = Bool(q.op, tuple(rewrite(p, change) for p in q.parts))
    elif isinstance(q, Fielded):
        q = Fielded(q.field, rewrite(q.query, change), q.boost)
    return change(q)


def with_synonyms(q, table: dict[str, list[str]], factor: float = 0.8):
    def change(x):
        if isinstance(x, Term) and x.text.lower() in table:
            return Bool("OR", (x, *(Term(t, factor) for t in table[x.text.lower()])))
        return x

    return rewrite(q, change)


def with_fields(q, table: dict[str, dict[str, float]]):
    def change(x):
        if isinstance(x, Fielded) and x.field in table:
            return Bool("OR", tuple(Fielded(f, scaled(x.query, b)) for f, b in table[x.field].items()))
        return x

    return rewrite(q, change)


def with_spelling(q, suggest, factor: float = 0.7):
    def change(x):
        near = suggest(x.text)[:2] if isinstance(x, Term) and x.text else []
        return Bool("OR", (x, *(Term(t, factor) for t in near))) if near else x

    return rewrite(q, change)


def relaxed(q, level: int):
    """1: AND becomes OR; 2: terms of four letters may be one edit off; 3: terms of three letters become prefixes."""

    def change(x):
        if level == 1 and isinstance(x, Bool) and x.op == "AND":
            return Bool("OR", x.parts)
        if level == 2 and isinstance(x, Term) and len(x.text) >= 4:
            return Bool("OR", (x, Fuzzy(x.text, 1, 0.8 * x.boost)))
        if level == 3 and isinstance(x, Term) and len(x.text) >= 3:
            return Bool("OR", (x, Wildcard(x.text + "*", 0.6 * x.boost)))
        return x

    return rewrite(q, change)
