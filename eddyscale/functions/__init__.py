"""Column expressions and closed forms."""
