"""Registered queries of the spatial operators, and the SQL that they are held against."""

from __future__ import annotations

from . import octree_queries, source_queries, splat_queries, voxel_queries
from .registry import Query

_ALL = (voxel_queries.REGISTRY, octree_queries.REGISTRY, splat_queries.REGISTRY, source_queries.REGISTRY)


def queries() -> dict[str, Query]:
    return {name: f for r in _ALL for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _ALL for name, s in r.sql.items()}
