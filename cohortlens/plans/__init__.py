"""Composite plans and the query catalog over the benchmark tables."""
