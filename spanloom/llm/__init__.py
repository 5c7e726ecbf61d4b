"""Training-data operators: quality, deduplication, mixing, sharding, extraction, packing.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the thin
contract queries are in :mod:`spanloom.llm.queries`.
"""
