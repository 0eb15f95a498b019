"""Column functions: text, score transforms, distances."""
