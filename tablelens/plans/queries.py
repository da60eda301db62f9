"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from tablelens.plans import quality_queries, source_queries, surface_queries  # noqa: F401
from tablelens.plans import registry

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL

# Flagship query for the driver's smoke check: revenue by category with
# share of total (scan, semi join, join, distinct count, window, sort).
FLAGSHIP = "revenue_by_category_share"
