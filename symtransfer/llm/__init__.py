"""Training-data operators: quality, dedup, tokenising, packing, PII and licence scans.

Nothing outside this subpackage imports it.
"""
