"""Column expressions used by the table operators."""
