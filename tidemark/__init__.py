"""Incrementally maintained relational and semantic views on Spark."""
