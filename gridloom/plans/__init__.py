"""The registered queries of the core: QUERIES by name, and SQL for those that SQL can express."""

from . import grid_queries, io_queries, mask_queries, metric_queries, prep_queries, sampling_queries, text_queries, time_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
