"""Readers, writers, table schemas and parsers."""
