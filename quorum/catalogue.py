"""All queries of the engine's own operators, and their oracle SQL."""

from __future__ import annotations

from .plans import assembled, blending, boards, extras, modelling, relational, reports, season, usage  # noqa: F401  (registers their queries)
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
