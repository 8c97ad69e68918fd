"""Explainable entity matching as Spark jobs."""
