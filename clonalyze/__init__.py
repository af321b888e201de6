"""Immune-repertoire analytics as Spark DataFrame jobs."""
