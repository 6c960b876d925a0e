"""Column expressions and fixed values used by the operators."""
