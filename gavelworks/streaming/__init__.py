"""Structured Streaming jobs over the bid log."""
