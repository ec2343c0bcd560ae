"""Operators for preparing training text: packing, quality, deduplication, extraction, encoding."""
