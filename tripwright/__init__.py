"""Spark operators for cleaning, matching, encoding and judging trip tables."""
