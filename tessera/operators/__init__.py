"""Operators: DataFrame(s) -> DataFrame building blocks."""
