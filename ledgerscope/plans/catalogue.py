"""All queries of the catalogue."""

from ledgerscope.plans import knowledge, pages, reading, records, scoring, stores  # noqa: F401
from ledgerscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
