"""Queries of the engine; importing this package registers them."""

from talweg.plans import policies, relations, samples, shapes, terrain, variants
from talweg.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "policies", "relations", "samples", "shapes", "terrain", "variants"]
