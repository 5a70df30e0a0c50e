"""Operators for preparing training text: language, quality, duplicates, tokens, packing."""
