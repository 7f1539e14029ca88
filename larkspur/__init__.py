"""Larkspur: customer analytics and large-scale data processing on PySpark."""

__version__ = "0.1.0"
