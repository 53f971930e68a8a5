"""Column functions: text, vectors, scores, code and prompts."""
