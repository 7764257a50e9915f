"""Spark-native multi-hop retrieval analytics over text corpora."""

__version__ = "0.1.0"
