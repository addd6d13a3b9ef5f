"""The registered route queries and their SQL."""

from __future__ import annotations

from ridgeline.plans import file_queries, geo_queries, graph_queries, profile_queries, request_queries, route_queries, search_queries, service_queries, store_queries, track_queries  # noqa: F401  (registers its queries)
from ridgeline.plans.registry import ORACLES, QUERIES

FLAGSHIP = "recommended_routes"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
