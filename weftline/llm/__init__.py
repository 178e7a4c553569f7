"""Training-data operators: language id, quality, dedup, packing, PII, tokenization.

Nothing else in the library imports this subpackage.
"""
