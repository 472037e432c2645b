"""Incremental forms of the backfill and export jobs."""
