"""All queries of the engine's own operators and their DuckDB counterparts."""

from sextant.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
