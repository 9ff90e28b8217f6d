"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from . import allocation_queries, bar_queries, chain_queries, evaluation_queries, flow_queries, gate_queries, information_queries, intraday_queries, lookup_queries, more_queries, rank_queries, recall_queries, regime_queries, scalar_queries, source_queries, stream_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "e20_momentum_backtest"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
