"""All registered queries."""

from __future__ import annotations

from callsheet.plans import (
    clean_queries,
    document_queries,
    pseudo_queries,
    redact_queries,
    run_queries,
    scan_queries,
)
from callsheet.plans.query import Query


def registry() -> dict[str, Query]:
    return {
        **scan_queries.QUERIES,
        **clean_queries.QUERIES,
        **redact_queries.QUERIES,
        **pseudo_queries.QUERIES,
        **run_queries.QUERIES,
        **document_queries.QUERIES,
    }
