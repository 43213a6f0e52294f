"""Column functions: text, URLs, scores."""
