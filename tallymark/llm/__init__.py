"""Operators of a training-data pipeline: packing, search, extraction, deduplication, mixing, scoring, scans, archives."""
