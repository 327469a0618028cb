"""Every registered query of the extraction engine and its DuckDB twin."""

from docrec.plans import last_queries, loader_queries, carrier_queries, more_queries, rule_queries, segment_queries, whole_queries  # noqa: F401  (register their queries)
from docrec.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
