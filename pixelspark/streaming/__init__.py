"""Streaming of the image engine."""
