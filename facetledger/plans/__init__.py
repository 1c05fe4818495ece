"""Registered queries over the supplied tables."""

from facetledger.plans import corpus_queries, cost_queries, label_queries, quality_queries, session_queries, source_queries, taxonomy_queries
from facetledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
