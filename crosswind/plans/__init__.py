"""Registered queries, one per operator."""

from crosswind.plans import backtest_queries, candidate_queries, eval_queries, ledger_queries, panel_queries, score_queries, stream_queries, synthesis_queries  # noqa: F401
from crosswind.plans.registry import ORACLES, QUERIES  # noqa: F401
