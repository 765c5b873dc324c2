"""Operators for preparing training text: near-duplicates, licenses, languages, packing, privacy, URLs, tokens."""
