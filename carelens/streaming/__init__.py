"""Structured Streaming forms of the cleaning chain, de-duplication and counts."""
