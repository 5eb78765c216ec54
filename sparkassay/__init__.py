"""Data-quality audits of whole tables on Spark."""

from sparkassay.plans.audit import audit, summarize
from sparkassay.plans.registry import compute, get_metric, list_available_metrics

__all__ = ["audit", "compute", "get_metric", "list_available_metrics", "summarize"]
