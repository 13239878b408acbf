"""All registered queries of the library and their SQL."""

from srclens.plans import code_queries, fact_queries, text_queries  # noqa: F401  they register themselves
from srclens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
