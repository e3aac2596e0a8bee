"""Column functions: text and paths, and statistics."""
