"""Operators for large training corpora: counts, search, mixing, deduplication, scores and segmentations."""
