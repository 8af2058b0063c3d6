"""Plans of the image engine."""
