"""Spark-first engine for normalising and analysing prose documents."""

__version__ = "0.1.0"
