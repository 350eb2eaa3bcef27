"""All registered queries of the library, gathered from the families."""

from __future__ import annotations

from tagweave.plans import files, models, ranking, relational, registry  # noqa: F401  (each registers its queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
