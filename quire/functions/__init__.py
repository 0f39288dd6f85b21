"""Column expressions: URLs, text, and small computations."""
