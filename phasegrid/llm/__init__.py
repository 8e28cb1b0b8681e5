"""Training-data operators: extraction, deduplication, packing, mixing, scoring.

Nothing else in the package imports this subpackage.
"""
