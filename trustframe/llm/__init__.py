"""Operators for preparing training data: sharding, filtering, joining, search, encoding and formatting."""
