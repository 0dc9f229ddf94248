"""Registry of the core's queries and of the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


from fabulary.queries import book, catalog, context, extra, ingest, packets, reader, story  # noqa: E402, F401
