"""Counting k-mers of arriving sequences with Structured Streaming."""
