"""Hybrid (vector and keyword) search over discussion data, as Spark DataFrame operators."""
