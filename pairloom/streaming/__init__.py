"""Structured Streaming wrappers of batch operators."""
