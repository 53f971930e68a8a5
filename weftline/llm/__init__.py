"""Corpus operators for training data: counting, encoding, sharding, deduplication, cleaning and output.

Nothing else in the library imports this subpackage.
"""
