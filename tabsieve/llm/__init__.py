"""Operators for large training corpora: dedup, classification, extraction, encoding and mixing."""
