"""All registered queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from .operators import analytics, asof, audits, containment, exchange, learning, markup, matching, pages, phrases, records, relational, scalars, vectors  # noqa: F401  registration
from .plans.registry import COVERS, ORACLES, QUERIES
from .streaming import state  # noqa: F401  registration


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def covered() -> dict[str, str]:
    """Inventory ids by query."""
    return dict(COVERS)
