"""Column functions: vectors, text, numbers."""
