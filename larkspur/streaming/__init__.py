"""Structured Streaming over transaction and event feeds."""
