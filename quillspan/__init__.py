"""Spark-first code-retrieval and graph analytics engine."""

__version__ = "0.1.0"
