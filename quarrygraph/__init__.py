"""Spark-native code-graph and hybrid-retrieval analytics."""

__version__ = "0.1.0"
