"""Operators over DataFrames: chunking, search, vectors, duplicates, catalogue, tagging."""
