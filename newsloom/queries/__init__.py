"""Checked queries over the derived tables, one module per operator family."""

from newsloom.queries import clustering, entities, market, quality, reports, sources, streams, vectors  # noqa: F401
from newsloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
