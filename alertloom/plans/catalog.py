"""All registered queries, with the SQL that their rows must equal."""

from alertloom.plans import analysis_queries, core_queries, feature_queries, intel_queries, label_queries, neighbour_queries, report_queries, stream_queries, summary_queries, tier_queries, vector_queries  # noqa: F401  # register theirs
from alertloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
