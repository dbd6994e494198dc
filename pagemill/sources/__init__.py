"""Files as tables."""
