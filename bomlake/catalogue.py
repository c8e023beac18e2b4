"""All queries of the domain operators, and their SQL."""

from bomlake import compliance_queries, document_queries, enrich_queries, lookup_queries, scan_queries  # noqa: F401  register their queries
from bomlake.queries import ORACLES, QUERIES, dedup_by_ecosystem

__all__ = ["ORACLES", "QUERIES", "dedup_by_ecosystem"]
