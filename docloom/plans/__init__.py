"""Whole jobs: index, search, tag, duplicates, refresh."""
