"""The search service: configuration, orchestration, suggestions, pages and reports.  All of it runs on the driver and returns plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import querylang as L
from . import search as S

#: How each field is analysed; others "standard".
ANALYZERS = {
    "title": "stemming", "abstract": "stemming", "keywords": "stemming", "note": "standard", "author": "author", "editor": "author", "journal": "keyword", "booktitle": "keyword", "publisher": "keyword",
    "series": "keyword", "school": "keyword", "institution": "keyword", "organization": "keyword", "doi": "keyword", "isbn": "keyword", "issn": "keyword", "url": "keyword",
}
#: The fields of the index (name, kind, boost).
FIELDS = [
    ("title", "text", 2.0), ("abstract", "text", 1.0), ("author", "text", 1.5), ("editor", "text", 1.2), ("note", "text", 0.5), ("journal", "keyword", 1.0), ("booktitle", "keyword", 1.0), ("publisher", "keyword", 0.8),
    ("series", "keyword", 0.8), ("school", "keyword", 0.8), ("institution", "keyword", 0.8), ("organization", "keyword", 0.8), ("keywords", "keyword", 1.2), ("tags", "keyword", 1.0), ("entry_type", "keyword", 1.0), ("key", "keyword", 1.0),
    ("doi", "keyword", 1.0), ("isbn", "keyword", 1.0), ("issn", "keyword", 1.0), ("url", "keyword", 1.0), ("year", "numeric", 1.0), ("volume", "numeric", 1.0), ("number", "numeric", 1.0), ("chapter", "numeric", 1.0),
    ("added", "date", 1.0), ("modified", "date", 1.0), ("content", "text", 0.8), ("search_text", "text", 1.0), ("author_list", "stored", 1.0), ("editor_list", "stored", 1.0),
]
#: Fields that are not taken apart, not stored, and not indexed.
WHOLE = {"key", "doi", "isbn", "issn", "url"}
NOT_STORED = {"content", "search_text"}
NOT_INDEXED = {"author_list", "editor_list"}
SEARCHABLE = {name for name, kind, _ in FIELDS if kind in ("text", "keyword")}
FACETS = [name for name, kind, _ in FIELDS if kind == "keyword"]
#: Field expansions with their boosts.
FIELD_EXPANSION = {"title": {"title": 1.0, "abstract": 0.5}, "author": {"author": 1.0, "editor": 0.7}, "venue": {"journal": 1.0, "booktitle": 0.9, "publisher": 0.6}, "content": {"title": 1.0, "abstract": 0.8, "keywords": 0.6, "note": 0.4}}


def analyzer_for(name: str) -> str:
    return ANALYZERS.get(name, "standard")


@dataclass
class Page:
    total: int
    offset: int
    limit: int

    @property
    def current(self) -> int:
        return self.offset // self.limit + 1

    @property
    def pages(self) -> int:
        return math.ceil(self.total / self.limit)

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total

    @property
    def has_previous(self) -> bool:
        return self.offset > 0


@dataclass
class Result:
    query: L.Bool | L.Term | object
    matches: DataFrame
    page: DataFrame
    facets: DataFrame
    suggestions: list[str] = field(default_factory=list)


@dataclass
class Service:
    """Built by ``with_`` steps: ranker, synonyms, field expansion, facets, limits."""

    records: DataFrame
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    fields: dict[str, dict[str, float]] = field(default_factory=lambda: dict(FIELD_EXPANSION))
    facets: tuple[str, ...] = ("type", "year", "journal")
    ranker: str = "match"
    expand: bool = False

    def with_synonyms(self, table: dict[str, list[str]]) -> Service:
        return Service(self.records, {**self.synonyms, **table}, self.fields, self.facets, self.ranker, True)

    def with_field(self, name: str, table: dict[str, float]) -> Service:
        return Service(self.records, self.synonyms, {**self.fields, name: table}, self.facets, self.ranker, self.expand)

    def with_ranker(self, how: str) -> Service:
        return Service(self.records, self.synonyms, self.fields, self.facets, how, self.expand)

    def parsed(self, text: str):
        q = L.parse(text)
        return L.with_fields(L.with_synonyms(q, self.synonyms), self.fields) if self.expand else q

    def matches(self, q) -> DataFrame:
        hit, score = S.evaluate(q)
        df = S.searchable(self.records).where(hit)
        return df.withColumn("score", score) if self.ranker == "match" else S.rank(df, L.terms(q) or [""], self.ranker)

    def search(self, text: str, limit: int = 20, offset: int = 0) -> Result:
        """Rank over all matches, then the page; facets over all matches."""
        limit, offset = max(1, min(1000, limit)), max(0, offset)
        q = self.parsed(text)
        found = self.matches(q)
        page = found.orderBy(F.desc(F.round("score", 6)), "row_id").offset(offset).limit(limit)
        long = found.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in self.facets])).alias("x")).select("x.*").where("value != ''")
        return Result(q, found, page, long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), [])

    def suggestions(self, text: str, n_matches: int, corrections: list[str] = ()) -> list[str]:
        """At most three: corrections first, a relaxed query when fewer than three match, the query without fields when fewer than five do."""
        q = L.parse(text)
        out = list(corrections[:2])
        if n_matches < 3 and str(L.relaxed(q, 1)) != str(q):
            out.append(str(L.relaxed(q, 1)))
        if n_matches < 5 and L.fields(q):
            out.append(" ".join(L.terms(q)))
        return list(dict.fromkeys(x for x in out if x))[:3]


def ranked_suggestions(q, spelling: dict, synonyms: dict, fields: dict) -> list[tuple[str, float]]:
    """Corrections at 0.8, synonyms at 0.7, field expansions at 0.6."""
    out = [(str(L.rewrite(q, lambda x: L.Term(spelling[x.text], x.boost) if isinstance(x, L.Term) and x.text in spelling else x)), 0.8)] if any(t in spelling for t in L.terms(q)) else []
    if any(t.lower() in synonyms for t in L.terms(q)):
        out.append((str(L.with_synonyms(q, synonyms)), 0.7))
    if any(f in fields for f in L.fields(q)):
        out.append((str(L.with_fields(q, fields)), 0.6))
    return out


def expand_text(text: str, table: dict[str, list[str]], most: int = 5) -> str:
    """Synonyms of the longest phrases of at most ``most`` words, both ways round."""
    both: dict[str, set[str]] = {}
    for k, vs in table.items():
        for a in (k, *vs):
            both.setdefault(a.lower(), set()).update(x.lower() for x in (k, *vs) if x.lower() != a.lower())
    words, out, k = text.split(), [], 0
    while k < len(words):
        for n in range(min(most, len(words) - k), 0, -1):
            phrase = " ".join(words[k : k + n])
            if phrase.lower() in both:
                out.append("(" + " OR ".join([phrase, *sorted(both[phrase.lower()])]) + ")")
                k += n
                break
        else:
            out.append(words[k])
            k += 1
    return " ".join(out)


def configured(custom: dict[str, dict] | None = None) -> list[dict]:
    """All fields of the index; settings of one's own change known fields or add new ones."""
    table = {n: {"name": n, "kind": k, "boost": b, "indexed": n not in NOT_INDEXED, "stored": n not in NOT_STORED, "analyzed": n not in WHOLE, "analyzer": ANALYZERS.get(n)} for n, k, b in FIELDS}
    for name, own in (custom or {}).items():
        if own.get("kind", "text") not in ("text", "keyword", "numeric", "date", "stored"):
            raise ValueError(f"no such kind of field: {own['kind']}")
        table[name] = {"name": name, "kind": "text", "boost": 1.0, "indexed": True, "stored": True, "analyzed": True, "analyzer": None} | table.get(name, {}) | own
    return list(table.values())


def build_collection(name: str, description: str | None = None, entry_keys: list[str] | None = None, query: str | None = None, parent: str | None = None) -> dict:
    """A collection that is either a list of keys, each once, or a query."""
    if not (name or "").strip():
        raise ValueError("a collection needs a name")
    if entry_keys and query:
        raise ValueError("a collection holds keys or a query, not both")
    return {"coll_name": name.strip(), "description": description, "entry_keys": None if query else list(dict.fromkeys(entry_keys or [])), "coll_query": query, "parent_id": parent}


def smart_collections(records: DataFrame, field: str) -> DataFrame:
    """A collection by query for each value of a field, with the number of its records."""
    return records.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.min("added").alias("created")).select(
        F.concat(F.lit(f"{field}:"), F.col(field)).alias("coll_query"), F.concat(F.lit("All of "), F.col(field)).alias("coll_name"), "n", "created"
    )


def tree_rows(tree: dict, parent: str | None = None) -> list[tuple[str, str | None]]:
    """(name, parent) of a nested dict, parents before children."""
    out = []
    for name, sub in tree.items():
        out.append((name, parent))
        out.extend(tree_rows(sub or {}, name))
    return out


def guarded_update(changes: dict) -> dict:
    """Changes without protected fields; a protected one is an error."""
    bad = {"key", "added"} & set(changes)
    if bad:
        raise ValueError(f"protected: {', '.join(sorted(bad))}")
    return changes


def report(rows: list, how: str = "markdown") -> str:
    """A quality report of (field, rule, severity, n) rows."""
    import html

    if how == "html":
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in r) + "</tr>" for r in rows)
        return f"<h1>Quality report</h1><table><tr><th>Field</th><th>Rule</th><th>Severity</th><th>Count</th></tr>{body}</table>"
    return "\n".join(["# Quality report", "", "| Field | Rule | Severity | Count |", "|---|---|---|---|", *("| " + " | ".join(map(str, r)) + " |" for r in rows)])
