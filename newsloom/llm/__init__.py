"""Operators for preparing training data: mixing, sharding, filtering, de-duplication, packing, search."""
