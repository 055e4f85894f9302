"""Names every query over the driver tables and its SQL twin."""

from __future__ import annotations

from scanengine.plans import evaluate_queries, fusion_queries, ray_queries, render_queries, stream_queries, streaming_queries, surface_queries, verify_queries

FLAGSHIP = "a1_fuse_voxels"
MODULES = (fusion_queries, stream_queries, surface_queries, evaluate_queries, verify_queries, ray_queries, streaming_queries, render_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
