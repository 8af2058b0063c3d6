"""Sources of the image engine."""
