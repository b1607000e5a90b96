"""All registered queries (name -> function of a session and a folder) and their DuckDB SQL."""

from . import changes, finding, formats, knowledge, links, people, records, reports  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
