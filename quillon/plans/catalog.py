"""All queries of the library with their SQL counterparts."""

from __future__ import annotations

from . import agents, cache, indexes, quality, records, retrieval, shapes, stores, streams, telemetry, text
from .registry import Query

FLAGSHIP = "retrieval_metrics"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _plan in (retrieval, indexes, quality, cache, telemetry, text, records, agents, shapes, streams, stores):
    QUERIES |= _plan.plans.queries
    ORACLES |= _plan.plans.oracles
