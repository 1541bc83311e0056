"""Structured Streaming jobs over live event feeds."""
