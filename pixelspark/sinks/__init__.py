"""Where results go besides tables."""
