"""Registry of the evaluation queries and their SQL counterparts.

Model outputs are not among the tables; where a query needs them it derives stand-ins from the tables, the same in both dialects.
"""

from evalloom.queries.registry import ORACLE, QUERIES
from evalloom.queries import generation, items, jobs, rollups, scoring  # noqa: F401  (they fill the registry)

__all__ = ["ORACLE", "QUERIES"]
