"""Structured Streaming twins of the batch plans."""
