"""Registered queries; importing this package fills the registry."""

from . import ingest_queries, memory_queries, rollup_queries, search_queries, service_queries, session_queries, stream_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ingest_queries", "memory_queries", "rollup_queries", "search_queries", "service_queries", "session_queries", "stream_queries", "text_queries"]
