"""Column functions and statistics."""
