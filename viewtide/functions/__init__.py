"""Column expressions, guards and order statistics."""
