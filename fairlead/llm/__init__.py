"""Operators that prepare training text: packing, sharding, deduplication, screening."""
