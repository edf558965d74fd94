"""Structured Streaming twins of the ordered operators."""
