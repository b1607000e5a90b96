"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from . import oracles, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLES = dict(oracles.SQL)
