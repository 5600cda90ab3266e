"""A catalog of named queries with the SQL that checks them."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.QUERIES: dict = {}
        self.SQL: dict = {}

    def add(self, name: str, run, sql: str | None = None) -> None:
        if name in self.QUERIES:
            raise ValueError(f"{name} is there already")
        self.QUERIES[name] = run
        if sql is not None:
            self.SQL[name] = sql
