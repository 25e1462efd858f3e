"""All registered queries of the engine."""

from . import changing, citing, clarifying, referring, releasing, reports, requesting, retrieval, selectors, star, structure, texts, valued  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
