"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from trackwell.plans import boards, odd, queries as plans, relations, searches, stores  # noqa: F401  (they add their queries)


def queries() -> dict:
    return dict(plans._all)


def oracle_sql() -> dict[str, str]:
    return dict(plans._sql)
