"""Functions of the image engine."""
