"""Training-data operators: deduplication, tokens, packing, secrets, quality and search.

Nothing else in the library imports this package.
"""
