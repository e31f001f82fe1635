"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import event_queries, relational_queries, service_queries, source_queries, stream_queries, text_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
