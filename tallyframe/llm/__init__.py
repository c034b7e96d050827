"""Training-data operators: deduplication, filtering, mixing, packing, media.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
