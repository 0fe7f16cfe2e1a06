"""All queries of the core with their SQL twins."""

from __future__ import annotations

from ..operators import profile
from . import details, discovery, feed, ingest, quality, scores, signals, stats, streams, temporal, texts

FLAGSHIP = "build_feed"
_MODULES = [feed, ingest, discovery, stats, signals, quality, details, temporal, texts, scores, streams, profile]
QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
