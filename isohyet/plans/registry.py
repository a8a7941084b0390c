"""name -> (query, SQL or None), filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function of (spark, folder) under its name; both sides give ``dates`` as text."""

    def keep(f: Callable) -> Callable:
        def run(spark, folder):
            out = f(spark, folder)
            return out.withColumns({n: F.col(n).cast("string") for n in (c.strip('"') for c in dates)}) if dates else out

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            SQL[f.__name__] = f"SELECT * REPLACE ({as_text}) FROM ({sql})" if dates else sql
        return f

    return keep
