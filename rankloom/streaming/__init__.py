"""Structured Streaming over the run registry."""
