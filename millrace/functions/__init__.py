"""Column expressions and literal rules shared by the operators."""
