"""All named queries with their SQL twins, gathered from the plan modules."""

from quern.plans import decisions, entities, offers, relational, statistics, stateful, texts  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
