"""Operators of a training-data pipeline: tokens, filters, de-duplication, sharding.

Nothing outside this package imports it; it may be removed as a whole.
"""
