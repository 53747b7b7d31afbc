"""All registered queries."""

from __future__ import annotations

from driftline.plans import (clean_queries, feature_queries, metric_queries, model_queries,  # noqa: F401
                             product_queries, store_queries,
                             validate_queries)
from driftline.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
