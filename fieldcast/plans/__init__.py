"""Registered queries: importing this package fills the registry."""

from fieldcast.plans import q_boards, q_cleaning, q_inseason, q_preseason, q_scoring, q_sources, q_tables, q_training  # noqa: F401
from fieldcast.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
