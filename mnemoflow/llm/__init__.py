"""Operators for the text of large training corpora."""
