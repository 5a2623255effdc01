"""Operators for preparing training text: deduplication, scoring, mixing, tokens, search."""
