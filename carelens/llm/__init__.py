"""Training-data operators: deduplication, quality, toxicity, token output, packing, URLs.

Nothing else in the library imports this subpackage.
"""
