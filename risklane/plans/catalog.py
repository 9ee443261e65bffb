"""All registered queries: importing a query module registers what it defines."""

from __future__ import annotations

from risklane.plans import registry
from risklane.plans import decision_queries, drift_queries, feature_queries, metric_queries, model_queries, profile_queries, routing_queries, stream_queries, velocity_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
