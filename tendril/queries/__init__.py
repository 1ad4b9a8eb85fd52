"""Operators bound to the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from tendril.catalog import QUERIES, SQL


def load() -> tuple[dict, dict]:
    from tendril.queries import history, market, monitors, quality, reports, sources, streams, tables  # noqa: F401

    return dict(QUERIES), dict(SQL)
