"""Column functions: text, parsing, keyed draws, scores."""
