"""Composed plans: routing, end-to-end search, and the query catalog."""
