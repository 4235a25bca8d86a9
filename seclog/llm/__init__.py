"""Operators for large text corpora: deduplication, filtering, extraction, packing, search and output."""
