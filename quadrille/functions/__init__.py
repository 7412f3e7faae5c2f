"""Column expressions and the numeric kernels behind the operators."""
