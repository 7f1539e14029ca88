"""Readers and the retail view over the driver's tables."""
