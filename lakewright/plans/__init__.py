"""Whole jobs: ingestion, catalogue sync, downstream rebuilds."""
