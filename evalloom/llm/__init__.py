"""Corpus preparation for training data: filtering, deduplication, scoring, archives and packing."""
