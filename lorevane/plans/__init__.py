"""Whole lifecycles: search, import, backfill, and the store that holds their tables."""
