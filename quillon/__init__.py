"""Retrieval-admissibility analytics as declarative Spark plans."""
