"""Collects the query modules; importing them registers their queries."""

from __future__ import annotations

from relaylens.plans import (  # noqa: F401
    metric_queries, routing_queries, state_queries, stream_queries, text_queries)
from relaylens.plans.registry import ORACLES, QUERIES

FLAGSHIP = "route_switchboard"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
