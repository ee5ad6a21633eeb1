"""Operators of a training-data pipeline: scans, deduplication, extraction, classification and mixing of texts."""
