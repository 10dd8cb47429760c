"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import audit_queries, intrinsic_queries, pair_queries, planning_queries, report_queries, retrieval_queries, split_queries, statistics_queries, text_queries  # noqa: F401  each module registers its queries
from .catalog import flagship, oracle_sql, queries  # noqa: F401
