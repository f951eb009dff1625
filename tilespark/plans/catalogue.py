"""The query catalogue of the library's operators with their DuckDB oracles."""

from __future__ import annotations

from tilespark.plans import batch_queries, index_queries, job_queries, mask_queries, outline_queries, patch_queries, pixel_queries, sampling_queries, slide_queries, source_queries, store_queries, telemetry_queries  # noqa: F401  (they register)
from tilespark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
