"""Operators for building training data: archives, search, near duplicates, extraction, scoring,
tokens and packing. Nothing else in the library imports this package."""
