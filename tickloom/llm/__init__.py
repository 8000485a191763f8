"""Operators for large text corpora: cleaning, deduplication, scoring, tokenising, formatting."""
