"""Training-data operators: deduplication, filtering, audits, search, packing.

Nothing else in the library imports this subpackage.
"""
