"""Operators for preparing training text: extraction, filters, duplicates, tokens, mixing."""
