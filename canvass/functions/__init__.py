"""Column builders, the expression language and distribution functions."""
