"""Column functions: text, classification."""
