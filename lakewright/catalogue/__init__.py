"""Registered queries with their SQL counterparts."""

from . import q_files, q_functions, q_ledger, q_quality, q_records, q_runs  # noqa: F401
from .registry import QUERIES, oracle_texts, query_functions  # noqa: F401
