"""Readers for event tables, event streams, rule files and binary files."""
