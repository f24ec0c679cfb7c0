"""Conversational retrieval and text-corpus processing as Spark jobs."""

__version__ = "0.1.0"
