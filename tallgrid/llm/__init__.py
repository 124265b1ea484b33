"""Operators that prepare training text: deduplication, decontamination, packing, scoring, formatting, search."""
