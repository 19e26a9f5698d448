"""All registered catalog queries and their SQL counterparts."""

from fernhill.plans import catalog_tables, delivery_queries, file_queries, lookup_queries, quality_queries, retrieval_queries  # noqa: F401
from fernhill.plans._book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
