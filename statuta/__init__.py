"""Retrieval over statutes and user documents on Spark."""
