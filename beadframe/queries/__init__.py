"""Registered queries over the given tables."""

from . import analysis_queries, signal_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
