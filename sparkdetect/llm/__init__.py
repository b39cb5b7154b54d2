"""Operators for preparing training text: sharding, deduplication, decontamination, filters, tokens."""
