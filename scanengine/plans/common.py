"""How the query modules register queries with their SQL twins."""

from __future__ import annotations

import re


def registrar(queries: dict, sql: dict):
    def query(name: str, twin: str | None = None):
        def add(f):
            queries[name] = f
            if twin is not None:
                sql[name] = re.sub(r"(?<!\")\bby\b(?!\")", '"by"', twin)  # the block column; the keyword is upper case here
            return f

        return add

    return query
