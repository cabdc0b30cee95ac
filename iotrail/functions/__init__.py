"""Column functions and distribution statistics."""
