"""Training-data operators: quality, toxicity, extraction, deduplication, packing.

Nothing outside this subpackage imports it.
"""
