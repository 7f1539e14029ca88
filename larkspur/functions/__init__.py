"""Column expressions with the statistics conventions that the operators share."""
