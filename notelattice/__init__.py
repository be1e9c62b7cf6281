"""Spark-native retrieval and knowledge-graph analytics over Markdown vaults."""

__version__ = "0.1.0"
