"""Structured Streaming versions of some operators."""
