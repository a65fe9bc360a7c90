"""Temporal facts, retrieval and text analytics as Spark jobs."""
