"""All queries over the driver tables, with their SQL."""

from __future__ import annotations

from . import calling_queries, coverage_queries, file_queries, reads_queries, variant_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "q11_exonic_enrichment"
