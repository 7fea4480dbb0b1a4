"""Operators that prepare training text: deduplication, filters, packing, search, tokenisation and scoring. Nothing else in the library imports them."""
