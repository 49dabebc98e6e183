"""Operators for building training data: dedup, filters, mixing and sharding.

Nothing outside this folder imports it.  `registry` lists its queries.
"""
