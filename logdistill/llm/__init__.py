"""Operators of a training-data pipeline: filters, deduplication, scoring, mixing, archives."""
