"""Column expressions and small statistics shared by the operators."""
