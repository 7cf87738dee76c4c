"""Column functions: kernels, distributions, expressions, text parsing."""
