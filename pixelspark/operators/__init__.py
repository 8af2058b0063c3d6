"""Operators of the image engine."""
