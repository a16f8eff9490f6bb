"""Column expressions: text, parsing and rates."""
