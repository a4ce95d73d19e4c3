"""Structured Streaming jobs built from the same plans as the batch path."""
