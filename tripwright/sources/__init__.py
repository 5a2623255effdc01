"""Readers and writers: typed CSV, report archives, zip members, nested JSON, run ledgers."""
