"""All registered queries."""

from __future__ import annotations

from servicenight.plans import invariants, loading, menu_mix, service, upsert, venue  # noqa: F401  (importing registers)
from servicenight.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
