"""All queries of the reference operators; importing this module registers them."""

from __future__ import annotations

from reckon.plans import queries_card, queries_match, queries_registry, queries_review, queries_rows, queries_sheets, queries_text, queries_whole  # noqa: F401
from reckon.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
