"""Collects the modules that register queries."""

from __future__ import annotations

from corpuskit.plans import collection_queries, curation_queries, item_queries, record_queries, search_queries, stream_queries  # noqa: F401  registers its queries
from corpuskit.plans.catalog import ORACLES, QUERIES, Query

FLAGSHIP = "hybrid_search_full"


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
