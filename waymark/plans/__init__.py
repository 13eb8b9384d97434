"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = (
    "scalar_queries",
    "source_queries",
    "filter_queries",
    "lookup_queries",
    "cloud_queries",
    "depth_queries",
    "geometry_queries",
    "vector_queries",
    "localize_queries",
    "window_queries",
    "route_queries",
    "stream_queries",
)


def load():
    """Import every query module and return (queries, oracles)."""
    for name in MODULES:
        importlib.import_module(f"waymark.plans.{name}")
    from waymark.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
