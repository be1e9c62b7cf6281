"""Operators for training-data pipelines over text, terms, vectors and scores."""
