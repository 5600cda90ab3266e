"""Structured predicates: three dialects that differ in nulls and case, compiled to one Column each.

dialect 'entry'  a null field matches only "equals null"; contains and friends ignore case
dialect 'repo'   the same tree, but null never matches, patterns are unsupported, and NOT looks at its first child
dialect 'spec'   conjunction of specs: equality is null-safe, != keeps nulls, ranges skip null, 0 and '', contains is case-sensitive,
                 and an unknown operator matches everything

Leaves are bare predicates where null means false anyway, so that they reach the Parquet scan;
only under NOT are they made two-valued.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = {"year", "pub_year", "row_id"}


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    children: tuple = ()


def _fits(name: str, value: Any) -> bool:
    """Ordered comparison across types is false, not an error."""
    return isinstance(value, (int, float)) and not isinstance(value, bool) if name in NUMERIC else not isinstance(value, (int, float))


def leaf(x: Leaf, dialect: str = "entry") -> Column:
    c, v = F.col(x.field), x.value
    never = F.lit(False)
    if dialect == "spec":
        return _spec(x)
    if x.op == "=":
        return (c.isNull() if dialect == "entry" else never) if v is None else c == F.lit(v)
    if x.op == "!=":
        return c.isNotNull() if v is None else c != F.lit(v)
    if x.op in (">", ">=", "<", "<="):
        if v is None or not _fits(x.field, v):
            return never
        return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[x.op]
    if x.op in ("contains", "starts_with", "ends_with"):
        low, w = F.lower(c.cast("string")), str(v).lower()
        return {"contains": low.contains(w), "starts_with": low.startswith(w), "ends_with": low.endswith(w)}[x.op]
    if x.op == "in":
        return c.isin(list(v)) if len(v) else never
    if x.op == "not_in":
        return ~c.isin(list(v)) if len(v) else c.isNotNull()
    if x.op == "matches":
        return c.cast("string").rlike(str(v)) if dialect == "entry" else never
    raise ValueError(f"unknown operator {x.op}")


def _spec(x: Leaf) -> Column:
    c, v = F.col(x.field), x.value
    if x.op == "=":
        return c.eqNullSafe(F.lit(v))
    if x.op == "!=":
        return ~c.eqNullSafe(F.lit(v))
    truthy = c.isNotNull() & (c != (F.lit(0) if x.field in NUMERIC else F.lit("")))
    if x.op in (">", ">=", "<", "<="):
        return truthy & {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[x.op]
    if x.op == "contains":
        return truthy & c.cast("string").contains(str(v))
    if x.op == "in":
        return c.isin([w for w in v if w is not None]) | (c.isNull() if None in v else F.lit(False))
    return F.lit(True)


def compile_tree(x: Leaf | Node, dialect: str = "entry") -> Column:
    if isinstance(x, Leaf):
        return leaf(x, dialect)
    kids = [compile_tree(k, dialect) for k in x.children]
    if x.kind == "not":
        if not kids:
            return F.lit(True) if dialect == "entry" else F.lit(False)
        inner = kids[0] if dialect == "repo" else reduce(lambda a, b: a & b, kids)
        return ~F.coalesce(inner, F.lit(False))
    if not kids:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if x.kind == "and" else (lambda a, b: a | b), kids)


@dataclass
class Query:
    """Fluent builder of a condition tree; ``or_where`` turns all that came before into one group."""

    root: Node = field(default_factory=lambda: Node("and"))

    def _add(self, x) -> Query:
        return Query(Node(self.root.kind, (*self.root.children, x)))

    def where(self, name: str, op: str, value: Any = None) -> Query:
        return self._add(Leaf(name, op, value))

    def where_type(self, t: str) -> Query:
        return self.where("type", "=", t)

    def where_year(self, y: int) -> Query:
        return self.where("year", "=", y)

    def where_year_range(self, a: int, b: int) -> Query:
        return self.where("year", ">=", a).where("year", "<=", b)

    def where_author_contains(self, s: str) -> Query:
        return self.where("author", "contains", s)

    def where_title_contains(self, s: str) -> Query:
        return self.where("title", "contains", s)

    def where_has_doi(self) -> Query:
        return self.where("doi", "!=", None)

    def or_where(self, name: str, op: str, value: Any = None) -> Query:
        if self.root.kind == "or":
            return self.where(name, op, value)
        before = self.root.children
        group = (before[0],) if len(before) == 1 else ((Node("and", before),) if before else ())
        return Query(Node("or", (*group, Leaf(name, op, value))))

    def where_not(self, name: str, op: str, value: Any = None) -> Query:
        return self._add(Node("not", (Leaf(name, op, value),)))

    def column(self, dialect: str = "entry") -> Column:
        return compile_tree(self.root, dialect)


@dataclass
class Spec:
    """Filters, order, offset and limit, run in this order."""

    filters: tuple = ()
    orders: tuple = ()
    skip: int = 0
    most: int | None = None

    def where(self, name: str, op: str, value: Any) -> Spec:
        return Spec((*self.filters, Leaf(name, op, value)), self.orders, self.skip, self.most)

    def where_in(self, name: str, values: list) -> Spec:
        return self.where(name, "in", values)

    def order_by(self, name: str, descending: bool = False) -> Spec:
        return Spec(self.filters, (*self.orders, (name, descending)), self.skip, self.most)

    def offset(self, n: int) -> Spec:
        return Spec(self.filters, self.orders, n, self.most)

    def limit(self, n: int | None) -> Spec:
        return Spec(self.filters, self.orders, self.skip, n)

    def run(self, df: DataFrame, tie: str = "row_id") -> DataFrame:
        for f in self.filters:
            df = df.where(leaf(f, "spec"))
        if self.orders:
            df = df.orderBy(*[F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_last() for n, desc in self.orders], tie)
        if self.skip:
            df = df.offset(self.skip)
        return df.limit(self.most) if self.most else df


def parse_export(text: str) -> Column:
    """``field:value`` with ranges ``a..b`` for numbers, substring otherwise; bare text looks in title and author."""
    name, colon, value = text.partition(":")
    name, value = name.strip().lower(), value.strip()
    if not colon:
        return Query().where_title_contains(text).or_where("author", "contains", text).column()
    if name in ("year", "volume", "number"):
        c = F.col(name) if name == "year" else F.expr(f"try_cast({name} as int)")
        if ".." in value:
            a, b = value.split("..", 1)
            return c.between(int(a), int(b))
        return c == int(value)
    return leaf(Leaf(name, "contains", value))
