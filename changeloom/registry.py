"""All registered queries of the library's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from changeloom.queries import QUERIES, SQL, activity, changes, contracts, decisions, graphs, histories, impacts, pairing, paths, reports, rows, specifications, texts  # noqa: F401

FLAGSHIP = "halflife_activity_customer"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
