"""Structured Streaming jobs over log segments."""
