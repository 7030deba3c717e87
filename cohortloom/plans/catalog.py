"""All registered queries."""

from cohortloom.plans import cleaning_queries, cluster_queries, inference_queries, model_queries, scan_queries, summary_queries, table_queries  # noqa: F401
from cohortloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
