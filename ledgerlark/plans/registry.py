"""Registration of queries: a function of (session, folder) and, where SQL can express it, DuckDB SQL."""

from collections.abc import Callable

from ledgerlark.io import load

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of the named tables (as DataFrames) under its own name."""

    def register(f: Callable) -> Callable:
        def run(spark, sf_dir):
            return f(*[load(spark, sf_dir, t) for t in tables])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
