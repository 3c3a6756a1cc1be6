"""tessera — Spark-native corpus retrieval, indexing and evaluation.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
native Spark SQL expressions, joins, windows and Structured Streaming.
"""

__version__ = "0.1.0"
