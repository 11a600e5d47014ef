"""Column expressions and column-name selection shared by the operators."""
