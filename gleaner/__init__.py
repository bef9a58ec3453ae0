"""Curate large collections of items by a learned yes/no preference, on Spark."""

__version__ = "0.1.0"
