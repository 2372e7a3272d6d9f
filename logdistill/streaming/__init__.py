"""Structured Streaming forms: segments, archive sink and live counters."""
