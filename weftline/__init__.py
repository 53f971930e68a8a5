"""Weftline: retrieval and corpus processing as declarative Spark plans."""

__version__ = "0.1.0"
