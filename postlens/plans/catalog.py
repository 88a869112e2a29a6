"""All registered queries and oracles."""

from __future__ import annotations

from postlens.plans import catalog_drift, catalog_learn, catalog_rows, catalog_text, catalog_web

PARTS = [catalog_text.R, catalog_rows.R, catalog_web.R, catalog_drift.R, catalog_learn.R]


def queries() -> dict:
    return {key: fn for part in PARTS for key, fn in part.queries.items()}


def oracles() -> dict:
    return {key: sql for part in PARTS for key, sql in part.oracles.items()}
