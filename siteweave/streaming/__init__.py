"""Incremental listing intake with Structured Streaming."""
