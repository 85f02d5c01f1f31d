"""Column expressions, lexicons and patterns."""
