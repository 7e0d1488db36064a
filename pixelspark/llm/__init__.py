"""Training-data pipeline operators: tokenizing, formatting, filtering, dedup, packing, sharding.

Nothing outside this subpackage imports it.
"""
