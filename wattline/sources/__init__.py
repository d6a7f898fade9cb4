"""Readers (SRC-01..SRC-06) and the declared schemas of the production data."""
