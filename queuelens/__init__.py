"""Freeway congestion analytics as plain Spark DataFrame transformations."""
