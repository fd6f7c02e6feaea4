"""Registered queries (name -> callable of spark and a table folder) and the equivalent SQL.

`query` fixes a query's columns: keys as they are, `ints` as BIGINT, `doubles` rounded to eight places in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .views import CTES

QUERIES: dict = {}
ORACLE: dict = {}


def query(keys: str = "", ints: str = "", doubles: str = "", sql: str | None = None, uses: str = "", places: int = 8):
    """Registers f(views) under its name. sql may use the named views (and what they use)."""

    def register(f):
        def run(spark, sf_dir):
            from .views import Views

            out = f(Views(spark, sf_dir))
            return out.select(
                *keys.split(),
                *[F.col(x).cast("bigint").alias(x) for x in ints.split()],
                *[(F.round(F.col(x).cast("double"), places) + F.lit(0.0)).alias(x) for x in doubles.split()],
            )

        QUERIES[f.__name__] = run
        if sql:
            columns = [*keys.split(), *[f"CAST({x} AS BIGINT) AS {x}" for x in ints.split()], *[f"round(CAST({x} AS DOUBLE), {places}) + 0.0 AS {x}" for x in doubles.split()]]
            ctes = [f"{k} AS ({CTES[k]})" for k in uses.split()]
            ORACLE[f.__name__] = f"WITH {', '.join([*ctes, f'result AS ({sql})'])} SELECT {', '.join(columns)} FROM result"
        return f

    return register


from . import book_search, books, checks, factors, inference, lifecycle, performance, research, rules, scores, signals, stationarity, storage, structure  # noqa: E402, F401  they register their queries
