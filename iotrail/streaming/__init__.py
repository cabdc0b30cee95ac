"""Structured Streaming jobs over growing traces."""
