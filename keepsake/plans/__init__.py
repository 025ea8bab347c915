"""Importing this package registers every query."""

from keepsake.plans import (  # noqa: F401
    box_queries, catalogue_queries, entity_queries, intake_queries, publish_queries, record_queries, stream_queries,
    workflow_queries,
)
from keepsake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
