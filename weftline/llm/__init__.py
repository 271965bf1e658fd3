"""Training-data operators: scanning, deduplication, scoring, tokenising, mixing and search.

Nothing outside this subpackage imports it.
"""
