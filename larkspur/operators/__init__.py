"""Operators over transactions, customers, matrices, labels and experiment results."""
