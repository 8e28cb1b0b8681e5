"""Structured Streaming over arriving layers (an extension)."""
