"""Temporal pattern matching over event graphs on Spark."""
