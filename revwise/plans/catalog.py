"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from revwise.plans import (q_clusters, q_pipeline, q_report, q_reviews, q_runs, q_sources,  # noqa: F401
                           q_themes, q_vectors)
from revwise.plans.registry import QUERIES, oracle

__all__ = ["QUERIES", "oracle"]
