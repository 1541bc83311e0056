"""All registered queries by name."""

from __future__ import annotations

from sentrilake.plans.binary_queries import BINARY_QUERIES
from sentrilake.plans.event_queries import EVENT_QUERIES
from sentrilake.plans.graph_queries import GRAPH_QUERIES
from sentrilake.plans.query import Query
from sentrilake.plans.stream_queries import STREAM_QUERIES

QUERIES: dict[str, Query] = {
    **EVENT_QUERIES, **GRAPH_QUERIES, **BINARY_QUERIES, **STREAM_QUERIES,
}
