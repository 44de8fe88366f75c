"""Readers, writers and the role tables of the payment-integrity model."""

from claimtrace.sources.storage import read_rows, scratch_path, stream_rows, write_rows, written
from claimtrace.sources.tables import (
    LINE_KEY,
    SCHEMAS,
    as_case_events,
    case_events,
    claim_lines,
    document_vectors,
    documents,
    obligations,
    recoveries,
    search_queries,
    stream_events,
    table,
)

__all__ = [
    "LINE_KEY",
    "SCHEMAS",
    "as_case_events",
    "case_events",
    "claim_lines",
    "document_vectors",
    "documents",
    "obligations",
    "read_rows",
    "recoveries",
    "scratch_path",
    "search_queries",
    "stream_events",
    "stream_rows",
    "table",
    "write_rows",
    "written",
]
