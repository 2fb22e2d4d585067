"""Operators for text corpora: search, tokens, duplicates, packing, sharding, filters. Nothing else in the library imports this."""
