"""Registered queries and their SQL."""

from tidewindow.plans import decision_queries, frame_queries, model_queries, window_queries
from tidewindow.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decision_queries", "frame_queries", "model_queries", "window_queries"]
